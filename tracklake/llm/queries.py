"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fingerprints, html_extract, mixing, near_dedup, packing, sharding, toxicity, url_filter
from .shared import table

RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", *sharding.DIMENSIONS, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    done = chat.read_back(chat.format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens of each selected document and epoch."""
    rows = mixing.select_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), mixing.tokens(F.col("text")).alias("tokens"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found


_TEXT = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

OP1 = """
WITH u AS (
  SELECT page_id, coalesce(instr(url, '://') > 0, false) AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages
), p AS (
  SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

OP5 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), rows AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT e.y, r.seen FROM reach r JOIN both_ways e ON e.x = r.doc_id WHERE r.seen < e.y
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

OP7 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
    list_reduce(list_prepend(replace(text, '\\', '\\\\'), ['turn>', '/role>', 'sep/>', '/turn>']), lambda x, m: replace(x, '<' || m, '<\\' || m)) AS out
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(out) + CASE WHEN same THEN length('<sep/>') ELSE length('<turn>' || role || '</role>' || '</turn>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10 = f"""
WITH n AS (
  SELECT doc_id, {_TEXT} AS norm, length(coalesce(text, '')) AS chars FROM documents
), g AS (
  SELECT norm, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""


_SPACE = "[\\s\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_REFERENCES = [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&amp;?", "&")]


def _decoded(text: str) -> str:
    """HTML reads these names without their semicolon as well, as in a title that was cut."""
    for name, value in _REFERENCES:
        text = f"regexp_replace({text}, '{name}', '{value}', 'g')"
    return text


#: What stands between <article> and </article> on the synthetic pages, a line a block.
OP3 = f"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '(?s)<script.*?</script>|<!--.*?-->', '', 'g') AS x FROM pages
), b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '<br\\s*/?>', ' ', 'g'), '</?(p|h1|div|ul|li)[^>]*>', chr(1), 'g'), '<[^>]+>', '', 'g'), chr(1)) AS parts FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda p: trim(regexp_replace({_decoded('p')}, '{_SPACE}', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""


def _op9() -> str:
    """The budgets level by level, as mixing.budgets splits them, and the prefix of each leaf's last epoch."""
    recipe = mixing.RECIPE
    hashed = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"

    def weight(level: str) -> str:
        known = "".join(f" WHEN leaf.{level} = '{n}' THEN {w}" for n, w in recipe.weights.get(level, {}).items())
        return f"(CASE{known} ELSE 1.0 END)::DOUBLE" if known else "1.0::DOUBLE"

    same = lambda a, b, names: " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in names) or "true"
    text = f"""WITH d AS (
  SELECT doc_id, lang, source, 'domain' || coalesce({hashed('source')} % {recipe.domains}, 0) AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS n FROM d GROUP BY ALL
), g0 AS (SELECT least(floor(sum(n) * {recipe.budget}::DOUBLE), sum(n) * {recipe.max_epochs})::BIGINT AS given FROM leaf)"""
    for k, level in enumerate(mixing.LEVELS):
        up, keys = mixing.LEVELS[:k], mixing.LEVELS[: k + 1]
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        order = f"{part}ORDER BY usable DESC, c / w, {level} NULLS FIRST"
        text += f""", n{k} AS (SELECT {', '.join(f'leaf.{x}' for x in keys)}, {weight(level)} AS w0, sum(n)::BIGINT * {recipe.max_epochs} AS c, any_value(given) AS given
  FROM leaf JOIN g{k} ON {same('leaf', f'g{k}', up)} GROUP BY {', '.join(f'leaf.{x}' for x in keys)}
), u{k} AS (SELECT * EXCLUDE w0, w0 > 0 AND c > 0 AS usable, CASE WHEN w0 > 0 AND c > 0 THEN w0 ELSE 1.0 END AS w FROM n{k}
), s{k} AS (SELECT *, coalesce(sum(CASE WHEN usable THEN c END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(CASE WHEN usable THEN w END) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM u{k}
), f{k} AS (SELECT *, usable AND c <= (given - before) * w / after AS is_full FROM s{k}
), l{k} AS (SELECT *, usable AND NOT coalesce(is_full, false) AS is_open, given - sum(CASE WHEN is_full THEN c ELSE 0 END) OVER ({part}) AS rest,
    sum(CASE WHEN usable AND NOT is_full THEN w END) OVER ({part}) AS weights FROM f{k}
), p{k} AS (SELECT *, CASE WHEN is_open THEN floor(rest * w / weights) ELSE 0 END AS share FROM l{k}
), q{k} AS (SELECT *, rest - sum(share) OVER ({part}) AS spare, sum(is_open::INT) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM p{k}
), g{k + 1} AS (SELECT {', '.join(keys)}, (CASE WHEN is_full THEN c WHEN is_open THEN share + (nth <= spare)::INT ELSE 0 END)::BIGINT AS given FROM q{k})"""
    last = f"g{len(mixing.LEVELS)}"
    return text + f""", t AS (SELECT leaf.*, CASE WHEN n > 0 THEN given // n ELSE 1 END AS epochs, CASE WHEN n > 0 THEN given % n ELSE 0 END AS rest FROM leaf JOIN {last} ON {same('leaf', last, mixing.LEVELS)}
), r AS (SELECT d.*, t.epochs, t.rest, {hashed(f"concat_ws(':', '{recipe.seed}', t.epochs::BIGINT::VARCHAR, d.doc_id::VARCHAR)")} AS h FROM d JOIN t ON {same('d', 't', mixing.LEVELS)}
), c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM r)
SELECT doc_id, domain, lang, source, unnest(range((epochs + (rest > 0 AND upto <= rest)::INT)::BIGINT))::INT AS epoch, tokens::BIGINT AS tokens FROM c"""


def oracle_sql() -> dict[str, str]:
    """Packing, sharding, fingerprints and the classifier depend on hashes, tokenisers or training
    that SQL lacks; tests/llm checks the whole results of their queries against brute force."""
    return {"op1_url_filter": OP1, "op3_html_extract": OP3, "op5_near_dedup": OP5, "op7_chat_format": OP7, "op9_mixing": _op9(), "op10_exact_dedup": OP10}
