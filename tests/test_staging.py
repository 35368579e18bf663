import os
import threading

from quarry.plans import staging


def path_of(df):
    return df._quarry_path.removeprefix("file://")


def test_scopes_delete_their_own_tables_alone(spark):
    with staging.scope() as outer:
        first = staging.stage(spark.range(3), "a")
        with staging.scope() as inner:
            second, third = staging.stage(spark.range(4), "b"), staging.stage(spark.range(5), "c")
            inner.keep(second.join(spark.range(2), "id"))
        assert [os.path.exists(path_of(x)) for x in (first, second, third)] == [True, True, False]
        outer.keep(first)
    assert os.path.exists(path_of(first)) and not os.path.exists(path_of(second))
    staging.discard(first)
    assert not os.path.exists(path_of(first))


def test_threads_do_not_share_scopes(spark):
    with staging.scope():
        found = []
        thread = threading.Thread(target=lambda: found.append(staging.stage(spark.range(6), "other")))
        thread.start()
        thread.join()
        own = staging.stage(spark.range(7), "own")
    assert found[0].count() == 6 and not os.path.exists(path_of(own))
    staging.discard(found[0])


def test_failures_leave_nothing(spark):
    made = []

    @staging.scoped
    def broken():
        made.append(staging.stage(spark.range(2), "x"))
        raise KeyError("x")

    try:
        broken()
    except KeyError:
        pass
    assert not os.path.exists(path_of(made[0]))


def test_scoped_queries_keep_what_their_result_reads(spark):
    made = []

    @staging.scoped
    def query():
        made.extend(staging.stage(spark.range(n), f"with space {n}") for n in (8, 9))
        return made[0].groupBy((made[0].id % 2).alias("k")).count()

    result = query()
    assert [os.path.exists(path_of(x)) for x in made] == [True, False]
    assert sorted(r["count"] for r in result.collect()) == [4, 4]
    staging.discard(made[0])
