"""The registered queries of this subpackage: thin digests of what its operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jpeg import media_report, stored
from tidemark.llm.lines import line_bitmaps, line_report
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.pieces import piece_report
from tidemark.llm.quality import fit, held_out, with_scores
from tidemark.llm.secrets import secret_report
from tidemark.llm.shared import table
from tidemark.llm.suffixes import span_report
from tidemark.llm.templates import leaks
from tidemark.llm.tokens import token_records
from tidemark.llm.warc import capture_report

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The public vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).drop("tag")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_report(docs, line_bitmaps(docs, min_docs=10, min_chars=1))


def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_report(table(spark, sf_dir, "pages"), least=1000)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"), length=100)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(stored(table(spark, sf_dir, "documents"))).drop("width", "height")


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, percent=80).drop("tag")


QUERIES: dict[str, Query] = {
    "op1_token_records": op1_token_records,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_captures": op6_warc_captures,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_votes": op8_quality_votes,
    "op9_media_columns": op9_media_columns,
    "op10_template_leaks": op10_template_leaks,
}

_TRIMMED = "regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"
_KEY = f"translate({_TRIMMED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



#: (kind, expression, group, least length of the group, whether of the base) as the task words them.
_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", "[0-9a-f]+", 0, 24, True),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
)


def _secret_sql() -> str:
    """Starts are sums of the gaps and matches before; DuckDB's expressions take the leftmost, greedy match too."""
    spans = []
    for k, (kind, pattern, group, least, base) in enumerate(_SECRETS):
        p = pattern.replace("'", "''")
        spans.append(f"""
  select doc_id, {k} as kind, '{kind}' as name, {base} as base, starts[i] as start, starts[i] + length(m[i]) as stop
  from (select *, list_transform(range(1, len(m) + 1), lambda j: (list_sum(list_transform(g[1:j], lambda x: length(x))) +
      coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::bigint) as starts
    from (select doc_id, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as v, string_split_regex(t, '{p}') as g
      from (select doc_id, coalesce(text, '') as t from documents) where regexp_matches(t, '{p}')) where len(m) > 0), unnest(range(1, len(m) + 1)) as u(i)
  where length(v[i]) >= {least}""")
    counts = ", ".join(f"count(*) filter (where name = '{kind}')::bigint as n_{kind}" for kind, _, _, _, base in _SECRETS if base)
    joined = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by start, kind){}, '')"
    return f"""
with spans as ({" union all ".join(spans)})
select d.doc_id, {counts}, sha256({joined.format(" filter (where base)")}) as base_sha256, {joined.format(" filter (where name is not null)")} as spans
from documents d left join spans s on d.doc_id = s.doc_id group by d.doc_id
"""


ORACLE: dict[str, str] = {
    "op2_minhash_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as s
  from words, unnest(range(1, greatest(2, len(w) - 2))) as u(i) where len(w) > 0
), size as (select doc_id, count(*) as n from shingle group by doc_id),
few as (select s from shingle group by s having count(*) > 1),
pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as common
  from shingle a join few using (s) join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), link as (
  select x, y from pair p join size a on p.x = a.doc_id join size b on p.y = b.doc_id where 100 * common >= 80 * (a.n + b.n - common)
), way as (select x, y from link union select y, x from link),
reach(doc_id, place) as (select doc_id, doc_id from documents union select r.doc_id, w.y from reach r join way w on r.place = w.x)
select r.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(r.place) as component_id, r.doc_id = min(r.place) as kept
from reach r left join size s on r.doc_id = s.doc_id group by r.doc_id
""",
    "op3_secret_scan": _secret_sql(),
    "op5_line_dedup": f"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), lines as (
  select doc_id, u.pos, parts[u.pos] as line from split, unnest(range(1, len(parts) + 1)) as u(pos)
), keys as (
  select doc_id, pos, line, {_KEY} as line_key from lines
), common as (
  select line_key from keys where length(line_key) >= 1 group by line_key having count(distinct doc_id) >= 10
), marked as (
  select k.*, c.line_key is not null as gone from keys k left join common c on k.line_key = c.line_key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op6_warc_captures": """
with page as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), named as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as first from page
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from named
""",
}
