"""State that expires: late rows, forgotten symbols, restart from a checkpoint."""

import datetime as dt

import pytest

from tradeloom.streaming import streams as X

T0 = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def test_symbols_expire_and_survive_a_restart(rocks, tmp_path):
    schema = "symbol string, ts timestamp, win int"
    seen = []

    def feed(rows):
        """One more file, read by a query that starts anew from the checkpoint and ends when all is read."""
        rocks.createDataFrame([(s, T0 + dt.timedelta(hours=h), w) for s, h, w in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = X.expiring_outcome_state(rocks.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "1 hour", "1d")
        got = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/at").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        seen.append({r["symbol"]: (r["n"], r["win_rate_20"]) for r in got})
        return seen[-1]

    assert feed([("A", h, h % 2) for h in range(60)] + [("B", 59, 1)]) == {"A": (50, 0.5), "B": (1, 1.0)}
    assert feed([("A", 60, 1), ("B", 2, 0)]) == {"A": (50, 0.55)}  # B's row is later than the watermark
    found = feed([("A", 100, 1)])  # the watermark passes B's day
    assert found["A"] == (50, 0.55) and found["B"][0] == 0
    assert feed([("B", 101, 0)])["B"] == (1, 0.0)  # B begins anew
