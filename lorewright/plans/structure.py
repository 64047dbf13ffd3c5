"""Reading copies with offsets, section contexts, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import cleaning
from lorewright.operators import structure as S
from lorewright.plans.base import PAGES, pages, registrar, table
from lorewright.storage import in_tasks, materialize, tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

RUNNING = "The Adventure Guide"


def _joined(x: str) -> str:
    for pair in S.LIGATURE_SPLITS:
        head, tail = pair.split(" ")
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}]){pair}($|[^\p{{L}}])', '\1{head}{tail}\2', 'g')"
    return x


_CLEAN = _joined(r"regexp_replace(regexp_replace(regexp_replace(raw, '[\t ]+', ' ', 'g'), '[ \t]+([,.;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g')")


@register(rf"""WITH {PAGES}, px AS (SELECT document_id, page, '• ' || page || ' •' || chr(10) || 'the  adventure guide' || chr(10) || replace(text, ' the ', ' the fi rst  off er ; ') || chr(10) || page || chr(10)
    || CASE WHEN document_id % 2 = 0 THEN 'for a reader (Order #' || document_id || ')' ELSE 'terrifi es  ' END AS text FROM pg),
  pt AS (SELECT document_id, page, string_split(text, chr(10)) AS parts FROM px), ln AS (SELECT document_id, page, len(parts) AS n, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw FROM pt),
  c AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY document_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_start, {_CLEAN} AS c FROM ln),
  r AS (SELECT *, lower(c) = 'the adventure guide' OR line_no < 2 AND regexp_matches(c, '^•\s*\d{{1,3}}\s*•$') OR line_no >= n - 4 AND regexp_matches(c, '^\d{{1,3}}$') OR line_no = n - 1 AND regexp_matches(c, '\(Order #\d+\)$') AS removed FROM c WHERE c <> ''),
  s AS (SELECT *, coalesce(sum(CASE WHEN NOT removed THEN length(c) + 1 END) OVER (PARTITION BY document_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
  SELECT document_id, page, line_no, CAST(raw_start AS BIGINT) AS raw_start, CAST(raw_start + length(raw) AS BIGINT) AS raw_end, CASE WHEN NOT removed THEN CAST(pos AS BIGINT) END AS clean_start,
    CASE WHEN NOT removed THEN CAST(pos + length(c) AS BIGINT) END AS clean_end, CASE WHEN NOT removed THEN c END AS passage, removed FROM s""")
def reading_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns, printed with ornaments, a running line, split ligatures and marks of an order, with raw and clean offsets."""
    last = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("for a reader (Order #"), F.col("document_id").cast("string"), F.lit(")"))).otherwise("terrifi es  ")
    page = F.col("page").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("• "), page, F.lit(" •")), F.lit("the  adventure guide"), F.replace("text", F.lit(" the "), F.lit(" the fi rst  off er ; ")), page, last)
    return S.reading_passages(pages(spark, sf_dir).where("text IS NOT NULL").select("document_id", "page", text.alias("text")), [RUNNING])


_TEXTS = """lt AS (SELECT o_custkey AS document_id, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS line_no,
    CASE WHEN l_quantity <= 4 THEN repeat('#', 1 + p_size % 3) || ' ' || p_name WHEN l_quantity <= 8 THEN l_linenumber || '.' || p_size || ' Part' WHEN l_quantity <= 11 THEN 'Day ' || l_linenumber WHEN l_quantity <= 14 THEN 'RUMORS'
      WHEN l_quantity <= 17 THEN 'Traits' WHEN l_quantity <= 24 THEN ' Mill of ' || p_type WHEN l_quantity <= 27 THEN 'It is told in various regions.' WHEN l_quantity <= 30 THEN l_linenumber || ' Goblins'
      WHEN l_quantity <= 32 THEN 'Roll a d6 at once.' WHEN l_quantity <= 38 THEN 'The Adventure Guide' ELSE 'sold as ' || p_name || '.' END AS t
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
  li AS (SELECT document_id, page, line_no, trim(t) AS t, regexp_replace(regexp_replace(lower(trim(t)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_|_$', '', 'g') AS key FROM lt),
  w AS (SELECT *, lead(t) OVER o AS nxt, row_number() OVER o AS place, count(*) OVER (PARTITION BY document_id, page) AS n_lines, bool_or(regexp_matches(t, '(?i)\\bd\\d+\\b')) OVER (PARTITION BY document_id, page) AS dice FROM li WINDOW o AS (PARTITION BY document_id, page ORDER BY line_no)),
  kp AS (SELECT document_id, key, page, bool_or(place <= 3 OR place > n_lines - 3) AS edge, bool_or(length(t) <= 80) AS short, bool_or(NOT regexp_matches(t, '(?i)^(?:rumou?rs?|reports?|hearsay|day \\d+)$')) AS free FROM w WHERE key <> '' GROUP BY ALL),
  gone AS (SELECT document_id, key FROM kp JOIN (SELECT document_id, count(DISTINCT page) AS n FROM li GROUP BY 1) USING (document_id) GROUP BY document_id, key HAVING count_if(short) >= greatest(3, ceil(max(n) * 0.2)) AND count_if(edge) >= 3 AND bool_or(free)),
  hd AS (SELECT w.document_id, page, line_no, t, w.key, gone.key IS NOT NULL AS suppressed, t <> '' AND length(t) <= 80 AND NOT regexp_matches(t, '[.!?;:]$') AND len(string_split_regex(t, '\\s+')) <= 10
      AND NOT regexp_matches(t, '(?i)^(?:a|an|the|he|she|it|they|we|you|i|each|when|while|if|unless|on|at|in|as|then|there|introduce)$') AND NOT regexp_matches(t, '(?i)\\b(?:the|of|in|and|to|for|a|an|with)$')
      AND (regexp_matches(t, '^#{1,6}\\s|^\\d+(?:\\.\\d+)*[.)]?\\s+\\p{Lu}|^Day\\s+\\d+$') OR regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '\\p{Ll}') OR regexp_matches(t, '^(?:\\p{Lu}[\\p{L}''’-]*)(?:\\s+(?:of|the|near|in|and|to|for|a|an|\\p{Lu}[\\p{L}''’-]*))*$'))
      AND gone.key IS NULL AND NOT (regexp_matches(t, '^\\d+\\s+\\p{Lu}') AND dice)
      AND (regexp_matches(t, '(?i)^(?:rumou?rs?|reports?|hearsay|random (?:events|encounters|tables?|destinations))$') OR regexp_matches(t, '(?i)^#{1,6}\\s|^\\d+(?:\\.\\d+)+|^\\d+[.)]\\s|^Day\\s+\\d+$')
        OR regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '\\p{Ll}') OR coalesce(regexp_matches(nxt, '^(?:\\p{Lu}|[•*-])'), false)) AS heading FROM w LEFT JOIN gone ON gone.document_id = w.document_id AND gone.key = w.key)"""


def section_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Customers as documents, orders as pages, line items as lines whose kind hangs on the quantity; and the tasks for them.

    Lines take their text from parts first, then their place from orders, and are written: both exchanges are gone when a query reads them.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    tasks = tasks_for(item, S.LINES)
    item = item.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("string")
    kinds = [
        (4, F.concat(F.repeat(F.lit("#"), (1 + F.col("p_size") % 3).cast("int")), F.lit(" "), "p_name")), (8, F.concat(n, F.lit("."), F.col("p_size").cast("string"), F.lit(" Part"))), (11, F.concat(F.lit("Day "), n)), (14, F.lit("RUMORS")), (17, F.lit("Traits")),
        (24, F.concat(F.lit(" Mill of "), "p_type")), (27, F.lit("It is told in various regions.")), (30, F.concat(n, F.lit(" Goblins"))), (32, F.lit("Roll a d6 at once.")), (38, F.lit("The Adventure Guide")),
    ]
    text = F.concat(F.lit("sold as "), "p_name", F.lit("."))
    for most, kind in reversed(kinds):
        text = F.when(q <= most, kind).otherwise(text)
    place = F.row_number().over(S.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    item = item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("text"))
    item = item.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    with in_tasks(spark, tasks, broadcast=False):
        return materialize(item.select(F.col("o_custkey").alias("document_id"), F.col("l_orderkey").alias("page"), place.alias("line_no"), "text"), "lines"), tasks


@register(f"WITH {_TEXTS} SELECT document_id, page, line_no, key, suppressed, heading FROM hd")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines open a section, and which are running lines."""
    return S.section_lines(*section_source(spark, sf_dir)).select("document_id", "page", "line_no", "key", "suppressed", "heading")


@register(f"""WITH RECURSIVE {_TEXTS}, ev AS (SELECT document_id, page, -1 AS line_no, 's' AS kind, NULL AS key, NULL AS depth, regexp_matches(string_agg(t, chr(10) ORDER BY line_no), '(?i)\\b(?:various|different|several)\\b[\\s\\S]*\\b(?:districts|regions|areas|places|locations|groups)\\b') AS flag, 0 AS heads FROM hd GROUP BY document_id, page
    UNION ALL SELECT document_id, page, line_no, 'h', regexp_replace(regexp_replace(lower(ti), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_|_$', '', 'g'),
      CASE WHEN marks > 0 THEN marks WHEN num <> '' THEN len(string_split(num, '.')) WHEN regexp_matches(lower(ti), '^day\\s+\\d+') THEN 2 END, regexp_matches(ti, '\\p{{Ll}}') AND NOT regexp_matches(ti, '(?i)^(?:more|further|additional|major|new|other)\\s'), 0
      FROM (SELECT *, regexp_replace(t, '^#+\\s*', '') AS ti, length(regexp_extract(t, '^(#+)\\s', 1)) AS marks, regexp_extract(regexp_replace(t, '^#+\\s*', ''), '^(\\d+(?:\\.\\d+)*)(?:[.)]?\\s)', 1) AS num FROM hd WHERE heading)
    UNION ALL SELECT document_id, page, 1000000, 'e', NULL, NULL, NULL, count_if(heading) FROM hd GROUP BY document_id, page),
  nu AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, line_no) AS k FROM ev),
  st(document_id, page, kind, heads, k, path, root, context) AS (SELECT DISTINCT document_id, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, '' FROM nu
    UNION ALL SELECT document_id, page, kind, heads, k, CASE kind WHEN 's' THEN was WHEN 'h' THEN list_append(was[1:d - 1], key) ELSE CASE WHEN passing THEN [] ELSE was END END,
      CASE WHEN kind = 's' AND flag AND len(list_filter(was, lambda x: regexp_matches(x, 'rumou?r|reports?|hearsay'))) > 0 THEN was[1] WHEN kind = 'h' AND d = 1 OR kind = 'e' AND passing THEN NULL ELSE root END,
      CASE WHEN len(was) = 0 THEN 'main' ELSE array_to_string(was, ' > ') END
    FROM (SELECT nu.document_id, nu.page, nu.kind, CAST(nu.heads AS BIGINT) AS heads, nu.k, nu.key, nu.flag, st.path AS was, st.root, coalesce(nu.depth, CASE WHEN st.root IS NOT NULL AND nu.flag THEN 2 ELSE 1 END) AS d,
      len(list_filter(st.path, lambda x: regexp_matches(replace(x, '_', ' '), '(?i)^(?:magic|attack options|special actions|end of the round|actions|reactions|traits)$'))) > 0 AS passing FROM st JOIN nu ON nu.document_id = st.document_id AND nu.k = st.k + 1))
  SELECT document_id, page, context, heads AS headings FROM st WHERE kind = 'e'""")
def section_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of headings at the end of every page."""
    return S.section_contexts(*section_source(spark, sf_dir))


@register(rf"""WITH {PAGES}, n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1), x AS (SELECT document_id, page, n, string_split(text, chr(10)) AS p FROM pg JOIN n USING (document_id)),
  y AS (SELECT *, trim(regexp_replace(p[1], '\s+', ' ', 'g')) AS s, ' ' || array_to_string(list_transform(p, lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), ' ') || ' ' AS rest FROM x)
  SELECT document_id, page, n >= 2 AND page % 3 <> 0 AND length(s) >= 12 AND contains(s, ' ') AND contains(rest, ' ' || s || ' ') AS overlaid FROM y""")
def duplicate_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose first line is printed a second time between two running titles; on every third page the line between is of the page alone."""
    first = F.when(F.col("page") % 3 == 0, F.concat(F.split("text", "\n")[0], F.lit(" and no other"))).otherwise(F.split("text", "\n")[0])
    printed = pages(spark, sf_dir).where("text IS NOT NULL").select("document_id", "page", F.concat_ws("\n", F.lit(RUNNING), first, F.lit(RUNNING), "text").alias("text"))
    found = cleaning.overlaid_lines(cleaning.marked_lines(printed)).where("reason = 'duplicate_overlay'").select("document_id", "page", F.lit(True).alias("found"))
    return printed.join(found.distinct(), ["document_id", "page"], "left").select("document_id", "page", F.coalesce("found", F.lit(False)).alias("overlaid"))
