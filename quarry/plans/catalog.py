"""Queries of the mining engine on the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import baskets, columns
from quarry.operators import mining, prepare, results
from quarry.plans.staging import new_path, scoped
from quarry.sources import generator, loader, sinks
from quarry.sources.files import FileCatalogue
from quarry.sources.store import ResultStore
from quarry.streaming import incremental
from quarry.streaming.incremental import IncrementalState

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Parameters of the registered queries.
K, MIN_PROB, JOB = 20, 0.9, 2

BASKETS = """b AS (SELECT l_orderkey + 1 AS tid, CAST(replace(p_brand, 'Brand#', '') AS INT) AS item,
  CAST(sum(l_quantity) AS INT) AS quantity, 1 - 5 * max(l_discount) AS probability
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pr AS (SELECT item, CAST((item * 7) % 13 - 4 AS DOUBLE) AS profit FROM (SELECT DISTINCT item FROM b) x),
e AS (SELECT tid, item, profit, quantity * profit AS u, probability AS p FROM b JOIN pr USING (item)),
r AS (SELECT tid, sum(CASE WHEN profit > 0 THEN u ELSE 0 END) AS rtu, sum(u) AS tu FROM e GROUP BY tid),
w AS (SELECT item, sum(rtu) AS rtwu FROM e JOIN r USING (tid) WHERE p > 0 GROUP BY item),
k AS (SELECT item, rtwu, row_number() OVER (ORDER BY rtwu, item) - 1 AS rnk, row_number() OVER (ORDER BY rtwu DESC, item) - 1 AS prk FROM w),
v AS (SELECT tid, item, profit, u, ln(p) AS lp, rnk, prk, rtwu FROM e JOIN k USING (item) WHERE p > 0 AND ln(p) > -700),
l1 AS (SELECT *, coalesce(sum(CASE WHEN profit > 0 THEN u ELSE 0 END) OVER (PARTITION BY tid ORDER BY rnk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rem FROM v)"""
SINGLES = "s1 AS (SELECT item, sum(u * exp(lp)) AS eu, 1 - exp(sum(lp)) AS ep, count(*) AS n, sum(rem) AS rem, sum(greatest(0, u + rem) * exp(lp)) AS ub, any_value(rtwu) AS rtwu FROM l1 GROUP BY item)"
PAIRS = """p2 AS (SELECT least(a.item, c.item) AS item_a, greatest(a.item, c.item) AS item_b, sum((a.u + c.u) * exp(a.lp + c.lp)) AS eu,
  1 - exp(sum(a.lp + c.lp)) AS ep, count(*) AS n, sum(greatest(0, a.u + c.u + c.rem) * exp(a.lp + c.lp)) AS ub
  FROM l1 a JOIN l1 c ON a.tid = c.tid AND c.rnk > a.rnk GROUP BY 1, 2)"""
ALL_SETS = """s(tid, items, last_item, u, lp) AS (
  SELECT tid, [item], item, u, lp FROM v UNION ALL
  SELECT s.tid, list_append(s.items, v.item), v.item, s.u + v.u, s.lp + v.lp FROM s JOIN v ON s.tid = v.tid AND v.item > s.last_item WHERE s.lp + v.lp > -700),
g AS (SELECT items, sum(u * exp(lp)) AS eu, 1 - exp(sum(lp)) AS ep, count(*) AS n FROM s GROUP BY items),
top AS (SELECT row_number() OVER (ORDER BY eu DESC, ep DESC, len(items), items) AS rank, * FROM g WHERE eu >= 0 AND ep >= 0.9 - 1e-10 QUALIFY rank <= 20)"""
RESULTS = f"""{BASKETS}, {SINGLES}, {PAIRS},
x AS (SELECT [item] AS items, eu, ep, n FROM s1 UNION ALL SELECT [item_a, item_b], eu, ep, n FROM p2),
res AS (SELECT items[1] % 5 AS job_id, array_to_string(items, ',') AS items, items AS list, CAST(len(items) AS INT) AS size, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support,
  row_number() OVER (PARTITION BY items[1] % 5 ORDER BY round(eu, 4) DESC, round(ep, 6) DESC, len(items), items) AS rank FROM x WHERE eu >= 0)"""
JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status,
  CAST(o_custkey % 10 + 1 AS INT) AS k, CAST(floor(o_totalprice) AS BIGINT) AS execution_time_ms, CAST(o_orderdate AS DATE) AS created_on FROM orders)"""
RES_COLUMNS = "job_id, items, size, expected_utility, probability, support, rank"
JOB_COLUMNS = "job_id, status, k, execution_time_ms, strftime(created_on, '%Y-%m-%d') AS created_on"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(function):
        QUERIES[name] = scoped(function)
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return keep


def register(name: str, function, sql: str | None = None) -> None:
    query(name, sql)(function)


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tx = baskets.transactions(spark, d)
    return tx, baskets.profits(tx)


def _e(spark: SparkSession, d: str) -> DataFrame:
    return prepare.item_utility(*_pair(spark, d))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return prepare.ranked_items(prepare.rtwu(_e(spark, d)))


def _level(spark: SparkSession, d: str, size: int) -> DataFrame:
    return mining.level_statistics(*_pair(spark, d), size)


def _r4(c: str, alias: str | None = None) -> Column:
    return F.round(c, 4).alias(alias or c)


def _stats(df: DataFrame) -> DataFrame:
    return df.select(columns.items_key(F.col("items")).alias("items"), _r4("expected_utility"), F.round("probability", 6).alias("probability"), "support")


# --- sources -----------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The baskets written in the text format and numbered again on reading."""
    path = new_path(spark, "text")
    generator.transaction_lines(baskets.transactions(spark, d)).orderBy("tid").select("line").write.text(path)
    return loader.numbered_lines(spark, path)


def _files(spark: SparkSession, d: str) -> str:
    """A folder of real files: the baskets below ``database``, the profits below ``profit``; both in parts, sorted."""
    path, tx = new_path(spark, "files"), baskets.transactions(spark, d)
    generator.transaction_lines(tx).orderBy("tid").select("line").write.text(f"{path}/database")
    baskets.profits(tx).orderBy("item").select(F.concat_ws(" ", "item", F.format_string("%.1f", "profit"))).write.text(f"{path}/profit")
    return path


NUMBERED = f"WITH {BASKETS}, o AS (SELECT tid, row_number() OVER (ORDER BY tid) AS line FROM (SELECT DISTINCT tid FROM b) x)"
register("scan_transactions", lambda s, d: _lines(s, d).select("tid", F.size(F.split("line", " ")).alias("entries")), f"{NUMBERED} SELECT line AS tid, CAST(count(*) AS INT) AS entries FROM b JOIN o USING (tid) GROUP BY line")
register("parse_transactions", lambda s, d: loader.parse_transactions(_lines(s, d)), f"{NUMBERED} SELECT line AS tid, item, quantity, round(probability, 2) AS probability FROM b JOIN o USING (tid)")


@query("scan_profits", f"WITH {BASKETS} SELECT item, profit FROM pr")
def _scan_profits(spark, d):
    path = new_path(spark, "profits")
    baskets.profits(baskets.transactions(spark, d)).select(F.concat_ws(" ", F.col("item").cast("string"), F.col("profit").cast("string"))).write.text(path)
    return loader.read_profits(spark, path)


register("profit_validation", lambda s, d: loader.profit_validation(_pair(s, d)[1]), f"WITH {BASKETS} SELECT count(*) AS n_items, count(*) FILTER (profit < 0) AS n_negative FROM pr")
register("database_stats", lambda s, d: loader.database_stats(_pair(s, d)[0]), f"WITH {BASKETS}, c AS (SELECT tid, count(*) AS n FROM b GROUP BY tid) SELECT count(*) AS n_transactions, CAST(sum(n) AS BIGINT) AS n_entries, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM c")
register("dataset_metadata", lambda s, d: loader.dataset_metadata(_pair(s, d)[0]), f"WITH {BASKETS} SELECT count(DISTINCT tid) AS transaction_count, count(DISTINCT item) AS item_count FROM b")
FILES = f"""WITH {BASKETS}, lines AS (SELECT tid, string_agg(concat(item, ':', quantity, ':', printf('%.2f', probability)), ' ' ORDER BY item) AS line FROM b GROUP BY tid),
f AS (SELECT 'database' AS file_type, string_agg(line || chr(10), '' ORDER BY tid) AS body FROM lines
      UNION ALL SELECT 'profit', string_agg(concat(item, ' ', printf('%.1f', profit), chr(10)), '' ORDER BY item) FROM pr)"""
register("md5_checksum", lambda s, d: loader.list_files(s, _files(s, d)).select("file_type", "file_size", "checksum"), f"{FILES} SELECT file_type, CAST(strlen(body) AS BIGINT) AS file_size, md5(body) AS checksum FROM f")
register("files_by_type", lambda s, d: loader.list_files(s, _files(s, d), "database").select("file_type", "file_size"), f"{FILES} SELECT file_type, CAST(strlen(body) AS BIGINT) AS file_size FROM f WHERE file_type = 'database'")


def _catalogue(spark: SparkSession, d: str) -> FileCatalogue:
    found = FileCatalogue(spark, new_path(spark, "catalogue"))
    found.refresh(_files(spark, d))
    return found


@query("file_catalogue", f"{FILES} SELECT file_type, CAST(strlen(body) AS BIGINT) AS file_size, md5(body) AS checksum, 0 AS entered_again, true AS is_recent FROM f")
def _file_catalogue(spark, d):
    """All entries, found by their names; a second refresh enters nothing."""
    folder, found = _files(spark, d), FileCatalogue(spark, new_path(spark, "catalogue"))
    found.refresh(folder)
    again = found.refresh(folder)
    recent = found.files(after="2020-01-01").select("file_path", F.lit(True).alias("is_recent"))
    return found.files().join(recent, "file_path").select("file_type", "file_size", "checksum", F.lit(again).alias("entered_again"), "is_recent")


@query("files_after_delete", f"{FILES} SELECT file_type, md5(body) AS checksum FROM f WHERE file_type = 'profit'")
def _files_after_delete(spark, d):
    found = _catalogue(spark, d)
    found.delete(found.files(file_type="database").first()["file_name"])
    return found.files().select("file_type", "checksum")


@query("streamed_items", f"WITH {BASKETS}, {SINGLES} SELECT item, CAST(rtwu AS DOUBLE) AS rtwu, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support FROM s1")
def _streamed_items(spark, d):
    """The baskets as a stream of files, a batch for each, the first two of them compacted."""
    tx = baskets.transactions(spark, d)
    source, state = new_path(spark, "stream"), IncrementalState(spark, new_path(spark, "state"))
    tx.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in incremental.TX.split(", "))]).repartition(4, "tid").write.parquet(source)
    stream = spark.readStream.schema(incremental.TX).option("maxFilesPerTrigger", 1).parquet(source)
    profit = baskets.profits(tx)
    state.start(stream, profit, new_path(spark, "checkpoint")).awaitTermination()
    state.compact(1)
    return state.items().select("item", "rtwu", _r4("expected_utility"), F.round("probability", 6).alias("probability"), "support")


register("zipf_cdf", lambda s, d: generator.zipf_cdf(s, 100).select("item", F.round("cdf", 9).alias("cdf")), "WITH m AS (SELECT CAST(range AS INT) AS item, 1 / pow(range, 1.5) AS w FROM range(1, 101)) SELECT item, round(sum(w) OVER (ORDER BY item) / sum(w) OVER (), 9) AS cdf FROM m")


@query("generated_data")
def _generated(spark, d):
    c = generator.GeneratorConfig()
    return generator.generate_transactions(spark, c).join(generator.generate_profits(spark, c), "item")


# --- preparation -------------------------------------------------------------------------------------------------

register("item_utility", lambda s, d: _e(s, d).filter("p > 0").select("tid", "item", "u", F.round(F.ln("p"), 9).alias("lp")), f"WITH {BASKETS} SELECT tid, item, u, round(ln(p), 9) AS lp FROM e WHERE p > 0")
register("underflow_filter", lambda s, d: _e(s, d).filter("p > 0").select("tid", "item", (F.ln("p") * 1100).alias("x")).filter(F.col("x") > columns.LOG_FLOOR).select("tid", "item", F.round("x", 6).alias("lp")), f"WITH {BASKETS} SELECT tid, item, round(ln(p) * 1100, 6) AS lp FROM e WHERE p > 0 AND ln(p) * 1100 > -700")
register("rtu", lambda s, d: prepare.rtu(_e(s, d)), f"WITH {BASKETS} SELECT tid, CAST(rtu AS DOUBLE) AS rtu FROM r")
register("transaction_utility", lambda s, d: prepare.transaction_utility(_e(s, d)), f"WITH {BASKETS} SELECT tid, tu FROM r")
register("rtwu", lambda s, d: prepare.rtwu(_e(s, d)), f"WITH {BASKETS} SELECT item, CAST(rtwu AS DOUBLE) AS rtwu FROM w")
register("ranked_items", lambda s, d: _ranks(s, d), f"WITH {BASKETS} SELECT item, CAST(rtwu AS DOUBLE) AS rtwu, CAST(rnk AS INT) AS rank, CAST(prk AS INT) AS path_rank FROM k")
register("remaining_utility", lambda s, d: mining.level_one(*_pair(s, d)).select("tid", "item", "rem"), f"WITH {BASKETS} SELECT tid, item, CAST(rem AS DOUBLE) AS rem FROM l1")
register("utility_lists", lambda s, d: mining.level_one(*_pair(s, d)).select("item", "tid", "u", "rem", F.round("lp", 9).alias("lp")), f"WITH {BASKETS} SELECT item, tid, u, CAST(rem AS DOUBLE) AS rem, round(lp, 9) AS lp FROM l1")
register("candidate_pairs", lambda s, d: _candidates(mining.level_one(*_pair(s, d)).select("tid", "item", "rank")), f"WITH {BASKETS} SELECT DISTINCT a.item AS item_a, c.item AS item_b FROM l1 a JOIN l1 c ON a.tid = c.tid AND a.rnk < c.rnk")


def _candidates(singles: DataFrame) -> DataFrame:
    """Pairs of items that some transaction holds, the lower rank first; other pairs have no support."""
    later = singles.select("tid", F.col("item").alias("item_b"), F.col("rank").alias("rank_b"))
    return singles.join(later, "tid").filter("rank < rank_b").select(F.col("item").alias("item_a"), "item_b").distinct()


# --- statistics, joins and pruning -------------------------------------------------------------------------------

S1 = "CAST(item AS VARCHAR) AS items, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support"
P2 = "concat(item_a, ',', item_b) AS items, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support"
register("single_item_stats", lambda s, d: _stats(_level(s, d, 1)), f"WITH {BASKETS}, {SINGLES} SELECT {S1} FROM s1")
register("single_item_lists", lambda s, d: _stats(_level(s, d, 1).filter(columns.at_least(F.col("probability"), MIN_PROB))), f"WITH {BASKETS}, {SINGLES} SELECT {S1} FROM s1 WHERE ep >= 0.9 - 1e-10")
register("pair_join", lambda s, d: _stats(_level(s, d, 2)), f"WITH {BASKETS}, {PAIRS} SELECT {P2} FROM p2")
register("triple_join", lambda s, d: _level(s, d, 3).select(columns.items_key(F.col("items")).alias("items"), F.round("expected_utility", 6).alias("expected_utility"), F.round("probability", 6).alias("probability"), "support"), f"""WITH {BASKETS}, t AS (SELECT list_sort([a.item, c.item, f.item]) AS items, a.u + c.u + f.u AS u, a.lp + c.lp + f.lp AS lp
FROM l1 a JOIN l1 c ON a.tid = c.tid AND c.rnk > a.rnk JOIN l1 f ON f.tid = a.tid AND f.rnk > c.rnk)
SELECT array_to_string(items, ',') AS items, round(sum(u * exp(lp)), 6) AS expected_utility, round(1 - exp(sum(lp)), 6) AS probability, count(*) AS support FROM t GROUP BY t.items""")
register("itemset_stats", lambda s, d: _stats(_level(s, d, 1).unionByName(_level(s, d, 2))), f"WITH {BASKETS}, {SINGLES}, {PAIRS} SELECT {S1} FROM s1 UNION ALL SELECT {P2} FROM p2")
register("upper_bound", lambda s, d: _level(s, d, 2).select(columns.items_key(F.col("items")).alias("items"), _r4("bound")), f"WITH {BASKETS}, {PAIRS} SELECT concat(item_a, ',', item_b) AS items, round(ub, 4) AS bound FROM p2")
register("qualifying_itemsets", lambda s, d: _stats(_level(s, d, 2).filter((F.col("expected_utility") >= 0) & columns.at_least(F.col("expected_utility"), 1000.0) & columns.at_least(F.col("probability"), MIN_PROB))), f"WITH {BASKETS}, {PAIRS} SELECT {P2} FROM p2 WHERE eu >= 0 AND eu >= 1000 - 1e-10 AND ep >= 0.9 - 1e-10")
register("prune_rtwu", lambda s, d: prepare.rtwu(_e(s, d)).filter(columns.at_least(F.col("rtwu"), 700_000.0)), f"WITH {BASKETS} SELECT item, CAST(rtwu AS DOUBLE) AS rtwu FROM w WHERE rtwu >= 700000 - 1e-10")
register("prune_ep", lambda s, d: _stats(_level(s, d, 2).filter(columns.at_least(F.col("probability"), 0.999))), f"WITH {BASKETS}, {PAIRS} SELECT {P2} FROM p2 WHERE ep >= 0.999 - 1e-10")
register("prune_upper_bound", lambda s, d: _stats(_level(s, d, 2).filter(columns.at_least(F.col("bound"), 5000.0))), f"WITH {BASKETS}, {PAIRS} SELECT {P2} FROM p2 WHERE ub >= 5000 - 1e-10")
register("epsilon_compare", lambda s, d: _level(s, d, 1).select(columns.items_key(F.col("items")).alias("items"), (F.abs(F.col("probability") - 1) < columns.EPSILON).alias("is_one"), (F.col("expected_utility") > columns.EPSILON).alias("positive")), f"WITH {BASKETS}, {SINGLES} SELECT CAST(item AS VARCHAR) AS items, abs(ep - 1) < 1e-10 AS is_one, eu > 1e-10 AS positive FROM s1")
register("itemset_contains", lambda s, d: _level(s, d, 2).select(columns.items_key(F.col("items")).alias("items"), F.array_contains("items", 11).alias("has_11"), columns.contains_all(F.col("items"), F.array(F.lit(11), F.lit(22))).alias("has_both")), f"WITH {BASKETS}, {PAIRS} SELECT concat(item_a, ',', item_b) AS items, 11 IN (item_a, item_b) AS has_11, item_a = 11 AND item_b = 22 AS has_both FROM p2")
register("itemset_union", lambda s, d: _level(s, d, 2).select(columns.items_key(F.col("items")).alias("items"), columns.items_key(F.array_union("items", F.array(F.lit(11), F.lit(12)))).alias("united")), f"WITH {BASKETS}, {PAIRS} SELECT concat(item_a, ',', item_b) AS items, array_to_string(list_sort(list_distinct([item_a, item_b, 11, 12])), ',') AS united FROM p2")


@query("transaction_accessors", f"""WITH {BASKETS} SELECT tid, coalesce(max(quantity) FILTER (item = 11), 0) AS quantity_11, coalesce(max(probability) FILTER (item = 11), 0) AS probability_11,
  count(*) FILTER (item = 11) > 0 AS has_11, CAST(count(*) AS INT) AS size, array_to_string(list_sort(list(item)), ',') AS items FROM b GROUP BY tid""")
def _accessors(spark, d):
    wide = baskets.transactions(spark, d).groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("item", "quantity"))).alias("q"), F.map_from_entries(F.collect_list(F.struct("item", "probability"))).alias("p"))
    return wide.select("tid", F.coalesce(F.try_element_at("q", F.lit(11)), F.lit(0)).alias("quantity_11"), F.coalesce(F.try_element_at("p", F.lit(11)), F.lit(0.0)).alias("probability_11"), F.map_contains_key("q", 11).alias("has_11"), F.size("q").alias("size"), columns.items_key(F.map_keys("q")).alias("items"))


# --- top-k -------------------------------------------------------------------------------------------------------


def _top(spark: SparkSession, d: str, semantics: str = "exact") -> DataFrame:
    return mining.mine_topk(*_pair(spark, d), K, MIN_PROB, semantics)


TOP = f"WITH RECURSIVE {BASKETS}, {ALL_SETS} SELECT"
SETS = "array_to_string(items, ',') AS items, CAST(len(items) AS INT) AS size, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support"
PATH_SETS = """s(tid, items, root, last, u, lp) AS (
  SELECT tid, [item], rnk, -1, u, lp FROM v UNION ALL
  SELECT s.tid, list_append(s.items, v.item), s.root, v.prk, s.u + v.u, s.lp + v.lp FROM s JOIN v ON s.tid = v.tid AND v.rnk > s.root AND v.prk > s.last WHERE s.lp + v.lp > -700),
g AS (SELECT items, sum(u * exp(lp)) AS eu, 1 - exp(sum(lp)) AS ep, count(*) AS n FROM s GROUP BY items),
good AS (SELECT items FROM g WHERE ep >= 0.9 - 1e-10),
need AS (SELECT items, unnest(list_concat([items[1 : i] FOR i IN range(1, len(items) + 1)], [[x] FOR x IN items])) AS part FROM g),
bad AS (SELECT DISTINCT need.items FROM need ANTI JOIN good ON need.part = good.items),
top AS (SELECT list_sort(items) AS items, eu, ep, n FROM g ANTI JOIN bad ON g.items = bad.items WHERE eu >= 0 AND ep >= 0.9 - 1e-10 ORDER BY eu DESC, ep DESC, len(items), list_sort(items) LIMIT 20)"""


def _shown(top: DataFrame) -> DataFrame:
    return top.select(columns.items_key(F.col("items")).alias("items"), "size", _r4("expected_utility"), F.round("probability", 6).alias("probability"), "support")


register("topk_exact", lambda s, d: _shown(_top(s, d)), f"{TOP} {SETS} FROM top")
register("topk_path", lambda s, d: _shown(_top(s, d, "path")), f"WITH RECURSIVE {BASKETS}, {PATH_SETS} SELECT {SETS} FROM top")
register("topk_ranked", lambda s, d: sinks.ranked(_top(s, d)).select("rank", columns.items_key(F.col("items")).alias("items")), f"{TOP} CAST(rank AS INT) AS rank, array_to_string(items, ',') AS items FROM top")
register("topk_threshold", lambda s, d: _top(s, d).agg(F.round(F.when(F.count("*") == K, F.min("expected_utility")).otherwise(0.0), 4).alias("threshold")), f"{TOP} round(CASE WHEN count(*) = 20 THEN min(eu) ELSE 0 END, 4) AS threshold FROM top")


@query("mining_statistics")
def _mining_statistics(spark, d):
    """One row for each level of the search: itemsets evaluated and kept, threshold, share pruned."""
    return mining.mine(*_pair(spark, d), K, MIN_PROB).statistics()


@query("pruning_rates")
def _pruning_rates(spark, d):
    return results.pruning_rates(_mining_statistics(spark, d))


# --- exports -----------------------------------------------------------------------------------------------------

BRACES = "'{' || array_to_string(items, ', ') || '}'"
register("export_csv", lambda s, d: sinks.csv_rows(_top(s, d)), f"{TOP} CAST(rank AS INT) AS Rank, {BRACES} AS Itemset, printf('%.6f', eu) AS Utility, printf('%.6f', ep) AS Probability, n AS Support FROM top")
register("export_text", lambda s, d: sinks.text_lines(_top(s, d)), f"{TOP} CAST(rank AS INT) AS rank, printf('%d. ', rank) || {BRACES} || printf(' EU=%.4f P=%.4f S=%d', eu, ep, n) AS line FROM top")
register("export_json", lambda s, d: sinks.json_rows(_top(s, d)).select("rank", F.get_json_object("value", "$.items").alias("items"), F.get_json_object("value", "$.support").cast("long").alias("support")), f"{TOP} CAST(rank AS INT) AS rank, '[' || array_to_string(items, ',') || ']' AS items, n AS support FROM top")
CONSOLE_SQL = f"""CAST(rank AS INT) AS rank, printf('%-5d %-30s %12.4f %12.4f %8d', rank, CASE WHEN length({BRACES}) > 30 THEN ({BRACES})[1 : 27] || '...' ELSE {BRACES} END, eu, ep, n) AS line FROM top
UNION ALL SELECT -1, printf('%-5s %-30s %12s %12s %8s', 'Rank', 'Itemset', 'Utility', 'Probability', 'Support') UNION ALL SELECT 0, repeat('-', 70)"""
register("console_table", lambda s, d: sinks.console_lines(_top(s, d)), f"{TOP} {CONSOLE_SQL}")
register("console_configuration", lambda s, d: sinks.console_configuration(_pair(s, d)[0], K, MIN_PROB, F.to_timestamp(F.lit("2024-01-02 03:04:05"))).filter("at in (1, 3, 4, 5, 6, 9)"), f"""WITH {BASKETS}, c AS (SELECT count(DISTINCT tid) AS t, count(DISTINCT item) AS i FROM b)
SELECT CAST(unnest([1, 3, 4, 5, 6, 9]) AS INT) AS at, unnest([repeat(' ', 30) || 'MINING CONFIGURATION', format('Database Size:        {{:,}} transactions', t), format('Number of Items:      {{:,}} items', i), 'Top-K Target:         20 itemsets', 'Min Probability:      0.9000', 'Start Time:           2024-01-02 03:04:05']) AS line FROM c""")


@query("export_json_document", f"{TOP} CAST(count(*) AS INT) AS n, array_to_string(list(items ORDER BY rank)[1], ',') AS first_items, '2024-01-02T03:04:05' AS timestamp, true AS has_statistics FROM top")
def _json_document(spark, d):
    mined = mining.mine(*_pair(spark, d), K, MIN_PROB)
    x = sinks.json_document(mined.topk, [vars(x) for x in mined.levels], F.to_timestamp(F.lit("2024-01-02 03:04:05"))).select("value")
    of = lambda path: F.get_json_object("value", path)
    return x.select(F.json_array_length(of("$.topKItemsets")).alias("n"), F.btrim(of("$.topKItemsets[0].items"), F.lit("[]")).alias("first_items"), of("$.timestamp").alias("timestamp"), (of("$.statistics[0].itemsets").cast("long") > 0).alias("has_statistics"))


register("format_itemset", lambda s, d: _level(s, d, 3).select(columns.items_key(F.col("items")).alias("items"), columns.truncated(braces := columns.braces(F.col("items")), 10).alias("shown"), F.length(braces).alias("length")), f"""WITH {BASKETS}, t AS (SELECT DISTINCT list_sort([a.item, c.item, f.item]) AS items FROM l1 a JOIN l1 c ON a.tid = c.tid AND c.rnk > a.rnk JOIN l1 f ON f.tid = a.tid AND f.rnk > c.rnk),
f AS (SELECT items, {BRACES} AS x FROM t) SELECT array_to_string(items, ',') AS items, CASE WHEN length(x) > 10 THEN x[1 : 7] || '...' ELSE x END AS shown, CAST(length(x) AS INT) AS length FROM f""")
register("items_json", lambda s, d: _level(s, d, 2).select(columns.items_json(F.col("items")).alias("items_json")), f"WITH {BASKETS}, {PAIRS} SELECT concat('[', item_a, ',', item_b, ']') AS items_json FROM p2")
register("result_entities", lambda s, d: sinks.result_entities(_top(s, d), F.lit(1)).select("job_id", "items_json", "itemset_size", _r4("expected_utility"), F.round("probability", 6).alias("probability"), "support", "rank"), f"{TOP} 1 AS job_id, '[' || array_to_string(items, ',') || ']' AS items_json, CAST(len(items) AS INT) AS itemset_size, round(eu, 4) AS expected_utility, round(ep, 6) AS probability, n AS support, CAST(rank AS INT) AS rank FROM top")

# --- stored results ----------------------------------------------------------------------------------------------


def _results(function, *more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        out = function(baskets.stored(spark, d), *more)
        return out.withColumn("items", columns.items_key(F.col("items"))) if "items" in out.columns else out

    return run


def on_results(name: str, function, more: tuple, sql: str) -> None:
    register(name, _results(function, *more), f"WITH {RESULTS} {sql}")


def on_store(name: str, function, sql: str) -> None:
    """A query that the store answers by its indexes or the order of its files."""
    register(name, lambda s, d: function(baskets.store(s, d)).select(F.col("job_id").cast("int").alias("job_id"), columns.items_key(F.col("items")).alias("items"), "size", "expected_utility", "probability", "support", "rank"), f"WITH {RESULTS} {sql}")


OF_JOB = f"SELECT {RES_COLUMNS} FROM res WHERE job_id = {JOB}"
on_results("itemsets_by_rank", results.by_rank, (JOB,), OF_JOB)
on_results("itemsets_by_utility", results.by_utility, (JOB,), OF_JOB)
on_results("high_utility", results.high_utility, (JOB, 1000.0), f"{OF_JOB} AND expected_utility >= 1000")
on_results("itemsets_by_size", results.by_size, (JOB, 2), f"{OF_JOB} AND size = 2")
on_store("itemsets_containing", lambda x: x.containing(JOB, 12), f"{OF_JOB} AND list_contains(list, 12)")
on_results("itemsets_containing_text", results.containing_text, (JOB, "2"), f"{OF_JOB} AND items LIKE '%2%'")
on_store("search_itemsets", lambda x: x.search(JOB, "17"), f"{OF_JOB} AND (items LIKE '%17%' OR printf('%.4f', expected_utility) LIKE '%17%')")
on_results("page_totals", results.page_totals, (JOB, 10), f"SELECT count(*) AS total_elements, CAST(ceil(count(*) / 10) AS INT) AS total_pages FROM res WHERE job_id = {JOB}")
on_results("search_utility_probability", results.search_utility_probability, (500.0, 0.9, 1, 15), f"SELECT {RES_COLUMNS} FROM res WHERE expected_utility >= 500 AND probability >= 0.9 ORDER BY expected_utility DESC, probability DESC, job_id, rank LIMIT 15 OFFSET 15")
on_store("search_itemsets_by_grams", lambda x: x.search(JOB, "12,"), f"{OF_JOB} AND (items LIKE '%12,%' OR printf('%.4f', expected_utility) LIKE '%12,%')")
on_store("itemsets_page", lambda x: x.page(JOB, 2, 10), f"{OF_JOB} ORDER BY rank LIMIT 10 OFFSET 20")
on_results("job_topk", results.job_topk, (JOB, 10), f"{OF_JOB} ORDER BY expected_utility DESC, rank LIMIT 10")
on_results("global_topk", results.global_topk, (25,), f"SELECT {RES_COLUMNS} FROM res ORDER BY expected_utility DESC, probability DESC, job_id, rank LIMIT 25")
for _name, _column, _digits in (("utility_statistics", "expected_utility", 3), ("probability_statistics", "probability", 6)):
    on_results(_name, results.value_statistics, (_column, _digits), f"SELECT job_id, min({_column}) AS min_value, max({_column}) AS max_value, round(avg({_column}), {_digits}) AS avg_value FROM res GROUP BY job_id")
register("export_job", lambda s, d: sinks.csv_rows(results.by_job(baskets.stored(s, d), JOB)), f"WITH {RESULTS} SELECT CAST(rank AS INT) AS Rank, '{{' || array_to_string(list, ', ') || '}}' AS Itemset, printf('%.6f', expected_utility) AS Utility, printf('%.6f', probability) AS Probability, support AS Support FROM res WHERE job_id = {JOB}")
on_results("size_distribution", results.size_distribution, (), "SELECT job_id, size, count(*) AS n FROM res GROUP BY job_id, size")
on_results("count_by_job", results.counts, (), "SELECT job_id, count(*) AS n FROM res GROUP BY job_id")
on_results("count_high_utility", results.counts, (1000.0,), "SELECT job_id, count(*) AS n FROM res WHERE expected_utility >= 1000 GROUP BY job_id")
on_results("per_job_statistics", results.per_job_statistics, (), "SELECT job_id, count(*) AS n, max(expected_utility) AS max_utility, min(expected_utility) AS min_utility, max(probability) AS max_probability, min(probability) AS min_probability, max(size) AS max_size FROM res GROUP BY job_id")


@query("delete_job", f"WITH {RESULTS} SELECT {RES_COLUMNS} FROM res WHERE job_id <> {JOB}")
def _delete_job(spark, d):
    """What a store of its own holds after one of its jobs was deleted."""
    own = ResultStore(spark, new_path(spark, "results"))
    own.replace(baskets.stored(spark, d))
    own.delete([JOB])
    return own.results().select(F.col("job_id").cast("int").alias("job_id"), columns.items_key(F.col("items")).alias("items"), "size", "expected_utility", "probability", "support", "rank")


register("itemsets_with_job", lambda s, d: results.with_job(baskets.stored(s, d), baskets.jobs(s, d)).select("job_id", columns.items_key(F.col("items")).alias("items"), "rank", "status", "k"), f"WITH {RESULTS}, {JOBS} SELECT job_id, items, rank, status, k FROM res JOIN j USING (job_id)")
register("entity_formatting", lambda s, d: baskets.stored(s, d).select("job_id", "rank", columns.braces(F.col("items")).alias("itemset"), F.format_string("%.4f", "expected_utility").alias("utility"), F.round(F.col("probability") * 100, 4).alias("percentage"), (F.col("expected_utility") >= 1000).alias("is_high")), f"WITH {RESULTS} SELECT job_id, rank, '{{' || array_to_string(list, ', ') || '}}' AS itemset, printf('%.4f', expected_utility) AS utility, round(probability * 100, 4) AS percentage, expected_utility >= 1000 AS is_high FROM res")


def on_jobs(name: str, function, more: tuple, sql: str) -> None:
    def run(spark, d):
        out = function(baskets.jobs(spark, d), *more)
        return out.withColumn("created_on", F.date_format("created_on", "yyyy-MM-dd")) if "created_on" in out.columns else out

    register(name, run, f"WITH {JOBS} {sql}")


on_jobs("jobs_by_status", results.jobs_by_status, ("PENDING",), f"SELECT {JOB_COLUMNS} FROM j WHERE status = 'PENDING'")
on_jobs("jobs_page", results.jobs_page, (1, 25), f"SELECT {JOB_COLUMNS} FROM j ORDER BY j.created_on DESC, job_id LIMIT 25 OFFSET 25")
on_jobs("recent_jobs", results.jobs_since, ("1998-08-02", 30), f"SELECT {JOB_COLUMNS} FROM j WHERE j.created_on >= DATE '1998-08-02' - 30")
on_jobs("jobs_by_k", results.jobs_by_k, (5,), f"SELECT {JOB_COLUMNS} FROM j WHERE k = 5")
on_jobs("jobs_time_range", results.jobs_in_time, (50_000, 100_000), f"SELECT {JOB_COLUMNS} FROM j WHERE status = 'COMPLETED' AND execution_time_ms BETWEEN 50000 AND 100000")
on_jobs("top_jobs", results.slowest_or_fastest, (10, False), f"SELECT {JOB_COLUMNS} FROM j WHERE status = 'COMPLETED' ORDER BY execution_time_ms DESC, job_id LIMIT 10")
on_jobs("fastest_jobs", results.slowest_or_fastest, (10, True), f"SELECT {JOB_COLUMNS} FROM j WHERE status = 'COMPLETED' ORDER BY execution_time_ms, job_id LIMIT 10")
on_jobs("cancel_job", results.cancelled, (3,), "SELECT job_id, CASE WHEN job_id = 3 AND status IN ('PENDING', 'RUNNING') THEN 'FAILED' ELSE status END AS status, k, execution_time_ms, strftime(created_on, '%Y-%m-%d') AS created_on, CASE WHEN job_id = 3 AND status IN ('PENDING', 'RUNNING') THEN 'Job cancelled by user' END AS error_message FROM j")
on_jobs("job_flags", results.job_flags, (), "SELECT job_id, round(execution_time_ms / 1000.0, 3) AS execution_seconds, status IN ('COMPLETED', 'FAILED') AS is_completed, status = 'RUNNING' AS is_running FROM j")
on_jobs("job_statistics", results.job_statistics, (), "SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'PENDING') AS pending, round(coalesce(avg(execution_time_ms) FILTER (status = 'COMPLETED'), 0), 3) AS avg_ms, CAST(coalesce(sum(execution_time_ms) FILTER (status = 'COMPLETED'), 0) AS BIGINT) AS sum_ms, coalesce(max(execution_time_ms) FILTER (status = 'COMPLETED'), 0) AS max_ms, coalesce(min(execution_time_ms) FILTER (status = 'COMPLETED'), 0) AS min_ms FROM j")
register("truncate_error", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(columns.truncate_error(F.col("text")).cast("binary")).alias("message_md5")), "SELECT doc_id, md5(CASE WHEN text IS NULL THEN 'Unknown error' WHEN length(text) > 1000 THEN text[1 : 997] || '...' ELSE text END) AS message_md5 FROM documents")
