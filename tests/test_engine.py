import hashlib
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import mining, results
from quarry.plans import staging
from quarry.sources import generator, loader, sinks
from quarry.sources.store import ResultStore

SAMPLE = ["2:3:0.85 3:1:1.0 4:2:0.70", "1:1:1.0 2:1:0.60 3:3:0.75", "1:1:0.55 2:2:0.60 3:4:1.0 4:1:0.90 5:5:0.40", "2:3:0.90 4:1:0.45", "1:4:1.0 3:3:0.85 4:2:0.70 5:2:0.45"]
SAMPLE_PROFIT = {1: 6.0, 2: 7.0, 3: 1.0, 4: -5.0, 5: 3.0}


def frames(spark, lines, profit):
    rows = [(t, *[f(x) for f, x in zip((int, int, float), e.split(":"), strict=True)]) for t, line in enumerate(lines, 1) for e in line.split()]
    return spark.createDataFrame(rows, "tid long, item int, quantity int, probability double"), spark.createDataFrame(list(profit.items()), "item int, profit double")


def brute(lines, profit, k, min_prob):
    tx = [{int(a): (int(q), float(p)) for a, q, p in (e.split(":") for e in line.split())} for line in lines]
    out = []
    for n in range(1, len(profit) + 1):
        for items in itertools.combinations(sorted(profit), n):
            rows = [t for t in tx if all(i in t and t[i][1] > 0 for i in items)]
            if rows:
                chance = [math.prod(t[i][1] for i in items) for t in rows]
                eu, ep = sum(sum(profit[i] * t[i][0] for i in items) * c for t, c in zip(rows, chance, strict=True)), 1 - math.prod(chance)
                if eu >= 0 and ep >= min_prob - 1e-10:
                    out.append((-round(eu, 6), -round(ep, 6), n, list(items), len(rows)))
    return [(items, -eu, -ep, support) for eu, ep, _, items, support in sorted(out)[:k]]


def mined(spark, lines, profit, k, min_prob, semantics="exact"):
    return [(r["items"], round(r["expected_utility"], 6), round(r["probability"], 6), r["support"]) for r in mining.mine_topk(*frames(spark, lines, profit), k, min_prob, semantics).collect()]


def test_sample_matches_known_answers(spark):
    got = mined(spark, SAMPLE, SAMPLE_PROFIT, 10, 0.3)
    assert got[:3] == [([2], 49.35, 0.7246, 4), ([1, 3], 35.2, 0.649375, 3), ([2, 3], 34.0, 0.7705, 3)]
    assert got == brute(SAMPLE, SAMPLE_PROFIT, 10, 0.3) and len(got) == 10


def test_no_unsound_bound(spark):
    assert mined(spark, ["2:3:0.9", "3:4:0.9 2:4:0.9 1:3:0.8"], {1: 4.0, 2: 3.0, 3: 5.0}, 1, 0.0) == [([1, 2, 3], 28.512, 0.352, 1)]


def test_exact_and_path_differ_on_certain_items(spark):
    lines, profit = ["1:1:1.0 2:1:0.5"], {1: 10.0, 2: 4.0}
    assert mined(spark, lines, profit, 3, 0.3) == [([1, 2], 7.0, 0.5, 1), ([2], 2.0, 0.5, 1)]
    assert mined(spark, lines, profit, 3, 0.3, "path") == [([2], 2.0, 0.5, 1)]


def test_random_data_match_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        lines = [" ".join(f"{i}:{rng.randint(1, 4)}:{rng.choice([1.0, 0.9, 0.5, 0.35])}" for i in sorted(rng.sample(range(1, 7), rng.randint(1, 5)))) for _ in range(8)]
        profit = {i: float(rng.randint(-4, 8)) for i in range(1, 7)}
        k, min_prob = rng.choice([1, 3, 5]), rng.choice([0.0, 0.3, 0.6])
        assert [x[1:3] for x in mined(spark, lines, profit, k, min_prob)] == [x[1:3] for x in brute(lines, profit, k, min_prob)]


def test_join_does_not_stop_early(spark):
    rows = [(t, 1, 1, 0.5) for t in range(1, 301)] + [(t, 2, 1, 0.5) for t in range(201, 401)]
    tx = spark.createDataFrame(rows, "tid long, item int, quantity int, probability double")
    profit = spark.createDataFrame([(1, 1.0), (2, 1.0)], "item int, profit double")
    assert mining.level_statistics(tx, profit, 2).first()["support"] == 100


def test_bad_parameters(spark):
    tx, profit = frames(spark, SAMPLE, SAMPLE_PROFIT)
    for k, p, s in ((0, 0.3, "exact"), (1, 1.5, "exact"), (1, 0.3, "other")):
        with pytest.raises(ValueError):
            mining.mine(tx, profit, k, p, s)


def test_loader_rules(spark, tmp_path):
    path = tmp_path / "db.txt"
    path.write_text("# c\n\n1:2:0.9 2:4\n1:2: 3:x:0.5 4:-1:0.5 5:0:0.5 6:1:1.5\nx\n1:1:0.5 1:3:0.7\n7:1:NaN\n")
    got = sorted(tuple(r) for r in loader.read_transactions(spark, str(path)).collect())
    assert got == [(1, 1, 2, 0.9), (1, 2, 4, 1.0), (2, 1, 2, 1.0), (4, 1, 3, 0.7)]
    empty = tmp_path / "none.txt"
    empty.write_text("# only\n")
    with pytest.raises(ValueError, match="Transaction database is empty"):
        loader.read_transactions(spark, str(empty))
    assert loader.validate_file(spark, str(empty))["valid"] is False


def test_profit_formats(spark, tmp_path):
    """Each format keeps the last valid value of an item and skips what is not a pair of numbers."""
    (tmp_path / "p.txt").write_text("# losses too\n\n12 0.25\n7 -31\n7 -30.5\n9 1e2\nnine 4\n8\n8 1 1\n")
    (tmp_path / "p.csv").write_text("product, gain\n12 , 0.25,note\n7,-30.5\n9,100\n,3\n8,many\n")
    (tmp_path / "p.json").write_text('{"12": "0.25", "7": -30.5, "9": 1e2, "eight": 1, "8": null}')
    for name in ("p.txt", "p.csv", "p.json"):
        got = sorted(tuple(r) for r in loader.read_profits(spark, str(tmp_path / name)).collect())
        assert got == [(7, -30.5), (9, 100.0), (12, 0.25)], name
    (tmp_path / "none.txt").write_text("x y\n")
    with pytest.raises(ValueError, match="Profit table is empty"):
        loader.read_profits(spark, str(tmp_path / "none.txt"))


def test_csv_without_header_and_unknown_suffix(spark, tmp_path):
    (tmp_path / "q.csv").write_text("3,1.5\n4,2\n")
    assert sorted(tuple(r) for r in loader.read_profits(spark, str(tmp_path / "q.csv")).collect()) == [(3, 1.5), (4, 2.0)]
    assert [loader.detect_format(x) for x in ("a.TXT", "b.csv", "c.json", "d.bin", "e", "f.odd")] == ["text", "csv", "json", "binary", "text", "text"]


def test_generator(spark):
    c = generator.GeneratorConfig(50, 10, seed=42)
    tx, profit = generator.generate_transactions(spark, c), generator.generate_profits(spark, c)
    sizes = [r["count"] for r in tx.groupBy("tid").count().collect()]
    assert len(sizes) == 50 and 2 <= min(sizes) and max(sizes) <= 10
    low, high, p_low, p_high = tx.selectExpr("min(quantity)", "max(quantity)", "min(probability)", "max(probability)").first()
    assert 1 <= low and high <= 5 and 0.3 <= p_low and p_high <= 1.0
    assert all(-10 <= r["profit"] <= 50 for r in profit.collect())
    with pytest.raises(ValueError):
        generator.GeneratorConfig(10, 3, 2, 5)


def test_generator_draws_few_of_many_items(spark):
    c = generator.GeneratorConfig(400, 60, 3, 12, seed=5)
    rows = generator.generate_transactions(spark, c).collect()
    per = {}
    for r in rows:
        per.setdefault(r["tid"], []).append(r["item"])
    assert len(per) == 400 and all(3 <= len(v) <= 12 and len(set(v)) == len(v) for v in per.values())
    counts = [sum(i in v for v in per.values()) for i in range(1, 61)]
    assert min(counts) > 20 and sum(counts) == len(rows)  # about 50 each
    again = generator.generate_transactions(spark, c).repartition(3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_generator_zipf_follows_its_law(spark):
    c = generator.GeneratorConfig(3000, 20, 1, 1, zipf=1.5, seed=3)
    picked = {r["item"]: r["count"] / 3000 for r in generator.generate_transactions(spark, c).groupBy("item").count().collect()}
    before = 0.0
    for r in generator.zipf_cdf(spark, 20, 1.5).orderBy("item").collect():
        assert abs(picked.get(r["item"], 0.0) - (r["cdf"] - before)) < 0.03
        before = r["cdf"]


def test_suite_of_data_sets(spark, tmp_path):
    presets = {"tiny": generator.GeneratorConfig(20, 8, 2, 5), "other": generator.GeneratorConfig(10, 30, 1, 3)}
    assert generator.write_suite(spark, str(tmp_path), presets) == ["tiny_database", "tiny_profits", "other_database", "other_profits"]
    assert loader.database_stats(loader.read_transactions(spark, str(tmp_path / "tiny_database"))).first()["n_transactions"] == 20
    assert loader.read_profits(spark, str(tmp_path / "other_profits")).count() == 30
    assert set(generator.PRESETS) == {"small", "medium", "large", "dense", "sparse"}


def test_files(spark, tmp_path):
    for kind, text in (("database", "1:2:0.5\n"), ("profit", "1 2\n")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "f.txt").write_text(text)
    found = {r["file_type"]: (r["file_name"], r["file_size"], r["checksum"]) for r in loader.list_files(spark, str(tmp_path)).collect()}
    assert found == {k: ("f.txt", len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in (("database", "1:2:0.5\n"), ("profit", "1 2\n"))}
    loader.delete_files(spark, str(tmp_path / "profit" / "f.txt"))
    loader.delete_files(spark, str(tmp_path / "profit" / "f.txt"))
    assert [r["file_type"] for r in loader.list_files(spark, str(tmp_path)).collect()] == ["database"]


def test_levels_match_brute_force(spark):
    """Itemsets evaluated and kept at each level, with the bound worked out in plain Python."""
    rng = random.Random(11)
    lines = [" ".join(f"{i}:{rng.randint(1, 4)}:{rng.choice([0.9, 0.95, 0.8])}" for i in sorted(rng.sample(range(1, 9), 5))) for _ in range(30)]
    profit = {i: float(rng.randint(-4, 8)) for i in range(1, 9)}
    k, min_prob = 4, 0.3
    tx = [{int(a): (int(q), float(p)) for a, q, p in (e.split(":") for e in line.split())} for line in lines]
    gain = {t: sum(max(0.0, profit[i]) * q for i, (q, _) in row.items()) for t, row in enumerate(tx)}
    weight = {i: sum(gain[t] for t, row in enumerate(tx) if i in row) for i in profit}
    order = sorted(profit, key=lambda i: (weight[i], i))
    rank = {i: n for n, i in enumerate(order)}

    def facts(items):
        eu = bound = 0.0
        none, support = 1.0, 0
        for row in tx:
            if all(i in row for i in items):
                p = math.prod(row[i][1] for i in items)
                u = sum(profit[i] * row[i][0] for i in items)
                later = [i for i in row if rank[i] > max(rank[x] for x in items)]
                rem = sum(max(0.0, profit[i]) * row[i][0] for i in later)
                rem_p = sum(max(0.0, profit[i]) * row[i][0] * row[i][1] for i in later)
                best = max((row[i][1] for i in later), default=0.0)
                eu, none, support = eu + u * p, none * p, support + 1
                bound += min(max(0.0, u + rem), max(0.0, u) * best + rem_p) * p
        return eu, 1 - none, support, bound

    def best(sets):
        found = sorted((f[0] for f in map(facts, sets) if f[2] and f[0] >= 0 and f[1] >= min_prob - 1e-10), reverse=True)[:k]
        return found[-1] if len(found) == k else 0.0

    # pairs raise the threshold before any prefix goes on; a pair needs a root that the single items' threshold leaves
    singles, pairs = [(i,) for i in order], list(itertools.combinations(order, 2))
    low, high = best(singles), best(singles + pairs)
    weights = {i: sum(gain[t] * row[i][1] for t, row in enumerate(tx) if i in row) for i in order}
    met = [x for x in pairs if facts(x)[2] and facts(x[:1])[3] >= low and weights[x[0]] >= low and weights[x[1]] >= low]
    mined = mining.mine(*frames(spark, lines, profit), k, min_prob)
    one, two = mined.levels[:2]
    assert (one.itemsets, one.kept, one.met) == (len(order), sum(facts(x)[3] >= high for x in singles), sum(map(len, tx)))
    assert (two.itemsets, two.met, two.dropped) == (len(met), sum(facts(x)[2] for x in met), 0) and two.kept <= sum(facts(x)[3] >= high for x in met)
    assert abs(one.threshold - high) < 1e-6 and one.kept < sum(facts(x)[3] >= low for x in singles)
    joined = mining.Best(k, min_prob)
    levels = mining.search_by_joins(mining.level_one(*frames(spark, lines, profit)), joined, False, None)
    assert [r[:2] for r in joined.rows] == [(r["items"], r["size"]) for r in mined.topk.collect()] and len(levels) >= len(mined.levels) and levels[1].kept >= two.kept
    rates = results.pruning_rates(mined.statistics()).first()
    assert (rates["evaluated"], rates["kept"]) == (sum(x.itemsets for x in mined.levels), sum(x.kept for x in mined.levels)) and abs(rates["kept_share"] + rates["pruned_share"] - 1) < 1e-5
    assert (rates["met"], rates["join_success"]) == (sum(x.met for x in mined.levels), 1.0)


def test_a_mined_result_can_be_stored_and_searched(spark, tmp_path):
    top = mining.mine_topk(*frames(spark, SAMPLE, SAMPLE_PROFIT), 10, 0.3)
    store = ResultStore(spark, str(tmp_path / "store"))
    for job in (1, 2, 2):
        store.replace(sinks.result_entities(top.limit(3) if job == 1 else top, F.lit(job)))
    back = store.results()
    assert {r["job_id"]: r["count"] for r in back.groupBy("job_id").count().collect()} == {1: 3, 2: 10}
    assert [r["items"] for r in results.by_rank(back, 2).collect()][:3] == [[2], [1, 3], [2, 3]]
    assert results.page_totals(back, 1, 2).first()[:] == (2 + 1, 2)
    assert [r["rank"] for r in store.page(2, 1, 4).collect()] == [5, 6, 7, 8]
    assert [r["rank"] for r in store.containing(2, 5).collect()] == [r["rank"] for r in results.containing(back, 2, 5).collect()] != []
    for text in ("3", "1,3", "49.35", "8.12", "nothing", ""):
        assert [r["rank"] for r in store.search(2, text).collect()] == [r["rank"] for r in results.search(back, 2, text).collect()], text


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "PENDING"), (2, "COMPLETED"), (3, "RUNNING")], "job_id long, status string")
    after = lambda j: {r["job_id"]: (r["status"], r["error_message"]) for r in results.cancelled(jobs, j).collect()}
    assert after(3)[3] == ("FAILED", "Job cancelled by user") and after(3)[1] == ("PENDING", None) and after(2)[2] == ("COMPLETED", None)
    names = {results.new_job_id() for _ in range(50)}
    assert len(names) == 50 and all(re.fullmatch(r"job_\d{13}_[0-9a-f]{8}", x) for x in names)


def test_json_document(spark):
    mined = mining.mine(*frames(spark, SAMPLE, SAMPLE_PROFIT), 3, 0.3)
    doc = json.loads(sinks.json_document(mined.topk, [vars(x) for x in mined.levels], F.to_timestamp(F.lit("2024-01-02 03:04:05"))).first()["value"])
    assert doc["timestamp"] == "2024-01-02T03:04:05" and [x["items"] for x in doc["topKItemsets"]] == [[2], [1, 3], [2, 3]]
    assert doc["statistics"][0]["size"] == 1 and doc["statistics"][0]["itemsets"] == 5


def test_no_local_folder_on_a_cluster():
    class Session:
        def __init__(self, **values):
            self.conf = self
            self.values = values

        def get(self, name, other=None):
            return self.values.get(name.replace(".", "_"), other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.checkpoint_dir(Session(spark_master="spark://host:7077"))
    assert staging.checkpoint_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_exports(spark, tmp_path):
    top = mining.mine_topk(*frames(spark, SAMPLE, SAMPLE_PROFIT), 3, 0.3)
    for kind in ("csv", "json", "text"):
        sinks.export(top, str(tmp_path / kind), kind)
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "1. {2} EU=49.3500 P=0.7246 S=4"
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["Itemset"] == "{2}"


def test_lines_are_numbered_in_file_order_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Several files, cut into many blocks, with lines that do not count between."""
    want = []
    for name in "abc":
        text = [f"{name}{i}" + " x" * (i % 50) for i in range(700)]
        want += [x.strip() for x in text]
        (tmp_path / f"{name}.txt").write_text("\n\n# no\n  \n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        numbered = loader.numbered_lines(spark, str(tmp_path))
        assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString() and numbered.rdd.getNumPartitions() > 20
        assert [r["line"] for r in sorted(numbered.collect())] == want and [r["tid"] for r in sorted(numbered.collect())] == list(range(1, 2101))
        monkeypatch.setattr(loader, "BLOCKS", 3)
        assert [r["line"] for r in sorted(loader.numbered_lines(spark, str(tmp_path)).collect())] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_catalogue_reads_new_files_alone(spark, tmp_path, monkeypatch):
    from quarry.sources import files

    folder = tmp_path / "data"
    for kind, name, text in (("database", "a b.txt", "1:2:0.5\n"), ("profit", "p.txt", "1 2\n"), ("profit", "_hidden", "x")):
        (folder / kind).mkdir(parents=True, exist_ok=True)
        (folder / kind / name).write_text(text)
    found = files.FileCatalogue(spark, str(tmp_path / "catalogue"))
    assert found.files().count() == 0 and found.refresh(str(folder)) == 2 and found.refresh(str(folder)) == 0
    of = lambda **x: {(r["file_type"], r["file_name"], r["file_size"], r["checksum"]) for r in found.files(**x).collect()}
    want = {("database", "a b.txt", 8, hashlib.md5(b"1:2:0.5\n").hexdigest()), ("profit", "p.txt", 4, hashlib.md5(b"1 2\n").hexdigest())}
    assert of() == want and {x[1] for x in of(file_type="profit")} == {"p.txt"} and of(name="a b.txt") == want - of(file_type="profit")
    assert of(after="2001-01-01") == want and of(after="2999-01-01") == set()
    (folder / "profit" / "p.txt").write_text("1 2\n3 4\n")
    assert found.refresh(str(folder)) == 1 and ("profit", "p.txt", 8, hashlib.md5(b"1 2\n3 4\n").hexdigest()) in of() and len(of()) == 2
    assert found.delete("p.txt") == 1 and found.delete("p.txt") == 0
    assert {x[1] for x in of()} == {"a b.txt"} and not (folder / "profit" / "p.txt").exists() and found.refresh(str(folder)) == 0


def test_parts_of_one_write_are_one_file(spark, tmp_path):
    """No task collects a file: its parts follow each other by number, and are listed, hashed, searched and deleted as one."""
    from quarry.sources import files

    folder = tmp_path / "data" / "data base"
    rows = spark.range(1000, numPartitions=7).selectExpr("cast(id as string) as line")
    rows.write.text(str(folder))
    rows.limit(5).coalesce(1).write.mode("append").text(str(folder))
    (folder / "part-x.txt").write_text("x")
    body = "".join(f"{i}\n" for i in range(1000)).encode()
    want = sorted((len(x), hashlib.md5(x).hexdigest()) for x in (body, body[:10], b"x"))
    found = files.FileCatalogue(spark, str(tmp_path / "catalogue"))
    assert found.refresh(str(folder.parent)) == 3 and found.refresh(str(folder.parent)) == 0
    rows = found.files().collect()
    assert sorted((r["file_size"], r["checksum"]) for r in rows) == want == sorted((r["file_size"], r["checksum"]) for r in loader.list_files(spark, str(folder.parent)).collect())
    large = max(rows, key=lambda r: r["file_size"])["file_name"]
    assert large.count("*") == 2 and all("*" not in r["file_name"] for r in rows if r["file_name"] != large)
    assert found.delete(large) == 1 and len(list(folder.glob("part-*"))) == 2 and len(found.files().collect()) == 2


def test_catalogued_files_are_written_by_many_tasks(spark):
    """The sorted baskets are not brought into one task; their parts hold all of them in order."""
    from quarry.plans import catalog

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with staging.scope():
            listed = {r["file_type"]: r["parts"] for r in files_listed(spark, catalog._files(spark, "/root/testdata/sf0.001"))}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert set(listed) == {"database", "profit"} and len(listed["database"]) > 1


def files_listed(spark, path):
    from quarry.sources import files

    return files.listed(spark, path).collect()


def test_console(spark):
    top = mining.mine_topk(*frames(spark, SAMPLE, SAMPLE_PROFIT), 3, 0.3)
    lines = [r["line"] for r in sinks.console_lines(top).orderBy("rank").collect()]
    assert lines[1] == "-" * 70 and lines[0].split() == ["Rank", "Itemset", "Utility", "Probability", "Support"] and len(lines) == 5
    assert lines[2].split() == ["1", "{2}", "49.3500", "0.7246", "4"] and {len(x) for x in lines[2:]} == {len(lines[0])}
    assert [r["line"] for r in sinks.console_lines(top.limit(0)).collect()] == ["No itemsets found meeting the criteria."]
    shown = [r["line"] for r in sinks.console_configuration(frames(spark, SAMPLE, SAMPLE_PROFIT)[0], 3, 0.3, F.to_timestamp(F.lit("2024-01-02 03:04:05"))).orderBy("at").collect()]
    assert len(shown) == 11 and shown[0] == "=" * 80 and shown[3].endswith(" 5 transactions") and shown[4].endswith(" 5 items")
