"""Functions and settings that SQL can't express: the function registry, token counts, bundles on disk, settings."""

from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

from confabula import errors, settings
from confabula.functions import counting, registry, text
from confabula.operators import memory, messages, skills
from confabula.sources import bundles, written


def test_registered_functions_are_called_from_sql(spark):
    own = registry.Registry()
    own.register(registry.Definition("half_of", lambda x: x // 2, "long"))
    own.register(registry.Definition("half_of", lambda x: x / 2 if x % 2 else x // 2 * 1.0, "double"))
    own.register(registry.Definition("hidden_one", lambda: 1, "int", visible=False))
    assert len(own) == 2 and own.get("half_of").returns == "double" and own.get("none") is None
    assert own.derive().get("hidden_one") is None and own.derive(expose={"hidden_one"}, deny={"hidden_one", "half_of"}).get("half_of") is None
    assert own.derive(allow=set()).get("half_of") is None and own.derive(extra=[registry.Definition("more", str, "string")]).get("more")
    own.install(spark)
    assert [r.h for r in spark.sql("SELECT half_of(id) AS h FROM range(4)").collect()] == [0.0, 0.5, 1.0, 1.5]

    class Twice:
        def eval(self, x: int):
            yield (x,)
            yield (x,)

    table = registry.Registry()
    table.register(registry.Definition("twice_over", Twice, "x: int"))
    table.install(spark)
    assert spark.sql("SELECT * FROM twice_over(3)").count() == 2


@pytest.mark.parametrize("parameters", [{"type": "array"}, {"type": "object"}, {"type": "object", "properties": {}, "required": ["a"]}, {"type": "object", "properties": {}, "required": "a"}])
def test_parameter_schemas_are_checked(parameters):
    with pytest.raises(ValueError):
        registry.Definition("f", str, "string", parameters)


def test_tokens_are_counted_by_the_vocabulary_or_as_characters(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = spark.createDataFrame([("the house, of cards",), ("",), (None,), ("é" * 40,)], "t string")
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(r.t or "", add_special_tokens=False).ids) for r in rows.collect()]
    assert [r.n for r in rows.select(counting.token_count(F.col("t"), path).alias("n")).collect()] == want
    assert [r.n for r in rows.select(counting.token_count(F.col("t"), "/nowhere.json").alias("n")).collect()] == [19, 0, 0, 40]


def test_tokens_by_the_vocabulary_of_each_rows_model(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Split, WhitespaceSplit

    files = {}
    for name, cut in (("words", WhitespaceSplit()), ("commas", Split(",", "removed"))):
        t = Tokenizer(WordLevel({"?": 0}, unk_token="?"))
        t.pre_tokenizer = cut
        files[name] = str(tmp_path / f"{name}.json")
        t.save(files[name])
    known = {"big-*": files["words"], "big-small-*": files["commas"], "exact": files["commas"], "broken": "/nowhere.json"}
    rows = [("a b,c d", "big-1"), ("a b,c d", "big-small-1"), ("a b,c d", "exact"), ("a b,c d", "other"), ("a b,c d", None), ("a b,c d", "broken"), ("", "big-1"), (None, None)]
    got = spark.createDataFrame(rows, "t string, m string").select(counting.token_count_by_model(F.col("t"), F.col("m"), known, files["words"]).alias("n"))
    assert [r.n for r in got.collect()] == [3, 2, 2, 3, 3, 7, 0, 0]


def test_search_tokens_of_scripts_without_spaces(spark):
    got = spark.range(1).select(text.tokens(F.lit("Die ABC 你好世界 x ひら")).alias("t")).first().t
    assert got == ["die", "abc", "你好", "好世", "世界", "ひら"]


def test_bundles_on_disk(spark, tmp_path):
    root = tmp_path / "skills"
    for version in ("1.0", "1.1"):
        (root / "a" / version / "references").mkdir(parents=True)
        (root / "a" / version / "SKILL.md").write_text(f"---\nskill_id: other\ndisplay_name: 'A'\nversion: 9\ntriggers:\n  - x\n  - y z\n---\nBody {version}")
        (root / "a" / version / "references" / "n.md").write_bytes(b"\xff\xfe")
    (root / "b" / "2").mkdir(parents=True)
    (root / "b" / "2" / "SKILL.md").write_text("no frontmatter")
    got = {r.skill_id: r for r in bundles.bundles(spark, f"file://{root}").collect()}
    assert set(got) == {"a", "b"} and got["a"].version == "1.1" and got["a"].triggers == ["x", "y z"] and got["a"].display_name == "A"
    assert [(a.path, a.object_key, a.kind, a.size_bytes) for a in got["a"].assets_manifest] == [("references/n.md", "skills/a/1.1/references/n.md", "reference", 2)]
    assert got["b"].display_name == "b" and got["b"].enabled and got["b"].assets_manifest == [] and got["b"].skill_md == "no frontmatter"


def test_settings_are_typed():
    assert settings.Settings.parse("") == settings.Settings()
    own = settings.Settings.parse("# limits\nmax_steps: 7\nhigh_ratio: 0.9\n")
    assert own.max_steps == 7 and own.high_ratio == 0.9 and own.low_ratio == 0.5
    assert own.hot_list_ttl == "INTERVAL 24 HOURS"
    for bad in ("colour: red", "max_steps: many", "max_steps 3"):
        with pytest.raises(ValueError):
            settings.Settings.parse(bad)


def test_operators_take_their_limits_from_the_settings():
    own = settings.Settings.parse("low_ratio: 0.25\nhigh_ratio: 0.75\nresult_characters: 3")
    defaults = {name: p.default for f in (text.prompt_budget, text.truncate, messages.context_window, messages.hot_list, memory.recall, skills.match) for name, p in inspect.signature(f).parameters.items() if isinstance(p.default, int | float) and not isinstance(p.default, bool)}
    d = settings.DEFAULTS
    assert (defaults["default"], defaults["reserve"], defaults["least"], defaults["low"], defaults["high"], defaults["length"], defaults["k"]) == (d.context_tokens, d.output_reserve_tokens, d.least_prompt_tokens, d.low_ratio, d.high_ratio, d.hot_list_length, d.skills_a_turn)
    assert (own.low_ratio, own.high_ratio, own.result_characters, own.memory_limit) == (0.25, 0.75, 3, d.memory_limit)


def test_limits_that_were_read_are_followed(spark):
    own = settings.Settings.parse("low_ratio: 0.25\nhigh_ratio: 0.75\nresult_characters: 3")
    rows = spark.createDataFrame([(1, p, 10) for p in range(8)], "session_id long, pos long, token_count long")
    got = messages.context_window(rows, 100, own.low_ratio, own.high_ratio).orderBy("pos").collect()
    assert [r.bucket for r in got] == ["compress"] * 6 + ["keep"] * 2 and all(r.needs_compress for r in got)
    assert spark.range(1).select(text.truncate(F.lit("abcd"), own.result_characters).alias("t")).first().t.startswith("abc\n")


def test_codes_have_names_and_names_codes(spark):
    row = spark.range(1).select(errors.code_of(F.lit(errors.Outcome.PROVIDER_IN_USE)).alias("c"), errors.name_of(F.lit(40001)).alias("n"), errors.name_of(F.lit(1)).alias("none")).first()
    assert (row.c, row.n, row.none) == (40013, "SESSION_NOT_FOUND", None)


def test_failed_publishing_is_reported(spark, tmp_path):
    failed = []
    (tmp_path / "file").write_text("x")
    written.publisher(f"file://{tmp_path}/file", "t", failed.append)(spark.range(1), 0)
    assert len(failed) == 1
    written.append(spark.range(0), f"file://{tmp_path}/none", ["id"])
    assert not (tmp_path / "none").exists()
    row = spark.createDataFrame([(1, None, "é")], "id long, a string, b string")
    assert row.select(written.serialised(row).alias("j")).first().j == '{"a":null,"b":"é"}'
