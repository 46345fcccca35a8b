"""The registered queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, host_rules, jaccard_join, line_dedup, pieces, pii, quotes, shared, token_file, toxicity, url_cascade

#: Files of the public tokenizers; a parameter of the operators.
WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded_and_back(table(spark, sf_dir, "documents"), tokenizer(PIECES))
    return rows.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "same")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "token-file")
    return token_file.read(spark, folder, token_file.write(table(spark, sf_dir, "documents"), folder, tokenizer(WORD_BPE), by_word=True))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.decisions(table(spark, sf_dir, "documents"), similar=True)
    return rows.select("doc_id", F.size("kept").alias("n_kept"), F.array_join("kept", ",").alias("kept_lines"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes.conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", "parent", "branch", "position", "n_quoted", "n_linked", F.sha2("clean", 256).alias("clean_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_host_rules, op3_decontamination, op4_sentencepiece, op5_token_file, op6_toxicity, op7_url_cascade, op8_line_dedup, op9_quotation_linking, op10_ngram_jaccard_join,)}

OP2 = r"""with d as (select doc_id, source as host, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, ws[i:i + 7] as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) > 7)),
k as (select doc_id, i, count(*) over (partition by doc_id, g) as k from g),
r as (select doc_id, count(distinct i + j) as n from (select doc_id, i, unnest(range(8)) as j from k where k > 1) group by doc_id),
f as (select w.doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r on w.doc_id = r.doc_id),
x as (select *, n_words < 20 as short, 100 * n_repeat_words > 30 * n_words as repeats, 10 * n_symbols > n_words as symbols, 10 * n_dup_lines > n_words as lines, word_chars < 3 * n_words or word_chars > 12 * n_words as word_length from f),
h as (select host, count(*) as n, {sums} from x group by host), t as (select count(*) as k, sum(n) as total, sum(n::double * n) as q, {totals} from h), m as (select {moments} from t),
v as (select host, greatest({rates}, 0) > 0.5 as rejected from h, m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats as base_failed, not (short or repeats) and not coalesce(rejected, false) as kept from x left join v on x.host is not distinct from v.host"""
_M = "({r} + m_{r} * k_{r}) / (n + k_{r})"
_R = "case when x_{r} = 0 or x_{r} = total or total - q / total - (k - 1) <= 0 then 0.001 else least(0.5, greatest(0.001, ((s_{r} - x_{r}::double * x_{r} / total) / (x_{r} / total * (1 - x_{r} / total)) - (k - 1)) / (total - q / total - (k - 1)))) end"
_K = "x_{r} / total as m_{r}, 1 / (" + _R + ") - 1 as k_{r}"
OP2 = OP2.replace("{sums}", ", ".join(f"sum({r}::int) as {r}" for r in host_rules.RULES))
OP2 = OP2.replace("{totals}", ", ".join(f"sum({r}) as x_{r}, sum({r}::double * {r} / n) as s_{r}" for r in host_rules.RULES))
OP2 = OP2.replace("{moments}", ", ".join(_K.replace("{r}", r) for r in host_rules.RULES)).replace("{rates}", ", ".join(_M.replace("{r}", r) for r in host_rules.RULES))

OP7 = r"""with p as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
q as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from p),
l(kind, rule) as (values {rules}), s as (select *, split_part(rule, '/', 1) as h, substr(rule, instr(rule, '/')) as s from l),
b as (select page_id, rule, kind from (select page_id, rule, kind, row_number() over (partition by page_id order by length(rule) desc, kind desc) as rn from q join s on (host = h or ends_with(host, '.' || h)) and starts_with(path, s.s)) where rn = 1)
select q.page_id, host, path, rule, coalesce(kind, case when list_has_any(string_split(host, '.'), [{bad}]) then 'block' else 'allow' end) as verdict from q left join b on q.page_id = b.page_id"""
OP7 = OP7.replace("{rules}", ", ".join(f"('{k}', '{r}')" for k, r in url_cascade.RULES)).replace("{bad}", ", ".join(f"'{x}'" for x in url_cascade.BAD_LABELS))

OP9 = r"""select conv_id, turn, role, lag(turn) over w as parent, min(turn) over (partition by conv_id) as branch, row_number() over w - 1 as position, 0::bigint as n_quoted, 0::bigint as n_linked, sha256(text) as clean_sha256 from conversations window w as (partition by conv_id order by turn)"""

OP10 = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, root) as (select doc_id, doc_id from w union select l.b, r.root from r join l on r.doc_id = l.a)
select r.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(root) as component_id from r left join n on r.doc_id = n.doc_id group by r.doc_id"""

#: The tables hold no quoted line, so OP9 is the chain of turns; quotes are tested against small conversations.
ORACLES: dict[str, str] = {"op2_host_rules": OP2, "op7_url_cascade": OP7, "op9_quotation_linking": OP9, "op10_ngram_jaccard_join": OP10}
