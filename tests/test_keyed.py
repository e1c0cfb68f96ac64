"""Tables of which a change rewrites only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from confabula.operators import registry, sessions
from confabula.plans import chat
from confabula.sources import catalog
from confabula.sources.keyed import KeyedTable

SCHEMA = "id long, name string"


def files(path):
    return {str(p.relative_to(path)) for p in path.glob("*/*.parquet")}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_changes_touch_only_their_buckets(spark, tmp_path):
    own = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], 16)
    assert own.read().count() == 0
    own.create(spark.range(200).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")))
    before = files(tmp_path / "t")
    own.upsert(spark.createDataFrame([(3, "new"), (500, "more")], SCHEMA))
    after = files(tmp_path / "t")
    assert rows_of(own) == sorted([(i, "new" if i == 3 else f"n{i}") for i in range(200)] + [(500, "more")])
    assert 1 <= len({f.split("/")[0] for f in before ^ after}) <= 2
    own.update(spark.createDataFrame([(4, "x"), (900, "unknown")], SCHEMA))
    own.delete(spark.createDataFrame([(5, "")], SCHEMA))
    own.delete(spark.createDataFrame([], SCHEMA))
    assert rows_of(own) == sorted([(i, {3: "new", 4: "x"}.get(i, f"n{i}")) for i in range(200) if i != 5] + [(500, "more")])
    own.delete(own.read().where("id <> 7"))
    assert rows_of(own) == [(7, "n7")]
    own.delete(own.read())
    assert rows_of(own) == []
    own.upsert(spark.createDataFrame([(1, "b"), (1, "a")], SCHEMA), [F.asc("name")])
    assert rows_of(own) == [(1, "a")]


def ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def test_sessions_are_renamed_and_deleted_on_disk(spark, sf_dir, tmp_path):
    rows = catalog.sessions(spark, sf_dir)
    own = KeyedTable(spark, f"file://{tmp_path}/sessions", ddl(rows), ["id"], 32)
    own.create(rows)
    asked = rows.where("id IN (4, 8)").select("id", "user_id", F.lit("Renamed").alias("title"))
    before = files(tmp_path / "sessions")
    own.apply(asked, lambda old: sessions.rename(old, asked, chat.now()))
    assert sorted(map(str, own.read().collect())) == sorted(map(str, sessions.rename(rows, asked, chat.now()).select(own.read().columns).collect()))
    assert len({f.split("/")[0] for f in before ^ files(tmp_path / "sessions")}) <= 2
    own.apply(asked, lambda old: sessions.delete(old, asked))
    assert sorted(map(str, own.read().collect())) == sorted(map(str, sessions.delete(rows, asked).select(own.read().columns).collect()))


def test_bindings_are_written_back(spark, sf_dir, tmp_path):
    """Mappings are in buckets by model, so that siblings, whose preference a binding clears, are in the bucket that is rewritten."""
    old = catalog.mappings(spark, sf_dir)
    own = KeyedTable(spark, f"file://{tmp_path}/mappings", ddl(old), ["model_id", "provider_id"], 32, ["model_id"])
    own.create(old)
    wish = spark.createDataFrame([(1, 3, True, True), (2, 999, True, True)], "model_id long, provider_id long, is_preferred boolean, is_active boolean")
    before = files(tmp_path / "mappings")
    own.apply(wish, lambda rows: registry.bind(rows, wish, chat.now()))
    bound = registry.bind(old, wish, chat.now())
    assert sorted(map(str, own.read().collect())) == sorted(map(str, bound.select(own.read().columns).collect()))
    gone = spark.createDataFrame([(1, 3)], "model_id long, provider_id long")
    own.apply(gone, lambda rows: registry.unbind(rows, gone))
    assert sorted(map(str, own.read().collect())) == sorted(map(str, registry.unbind(bound, gone).select(own.read().columns).collect()))
    assert len({f.split("/")[0] for f in before ^ files(tmp_path / "mappings")}) <= 2
