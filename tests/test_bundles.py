"""Heads of skill documents, and the data source of bundles, as a table and as a stream."""

from __future__ import annotations

import os

import pytest

from confabula.functions.frontmatter import fields
from confabula.sources import bundle_source, bundles

HEAD = """# a comment
skill_id: helper   # trailing
display_name: "A \\"b\\" \\u4f60"
description: >-
  folded text
  of two lines

  and a paragraph
note: |
  kept
    as it is
enabled: no
version: 1.10
count: 12
ratio: -0.5
none: ~
triggers:
- plain one
- 'it''s'
- "x: y"
nested:
  list:
    - [1, two, {a: b}]
    -
      - deep
  map: {k: [v, 'w, x'], url: http://a.b/c}
assets:
  - path: references/a.md
    kind: reference
    description: long text
      that goes on
  - path: scripts/b.py
    kind: script
"""


def test_heads_are_read():
    got = fields(HEAD)
    assert got["skill_id"] == "helper" and got["display_name"] == 'A "b" 你' and got["description"] == "folded text of two lines\nand a paragraph"
    assert got["note"] == "kept\n  as it is\n" and got["enabled"] is False and got["version"] == 1.1 and got["count"] == 12 and got["ratio"] == -0.5 and got["none"] is None
    assert got["triggers"] == ["plain one", "it's", "x: y"]
    assert got["nested"] == {"list": [[1, "two", {"a": "b"}], ["deep"]], "map": {"k": ["v", "w, x"], "url": "http://a.b/c"}}
    assert got["assets"] == [{"path": "references/a.md", "kind": "reference", "description": "long text that goes on"}, {"path": "scripts/b.py", "kind": "script"}]


@pytest.mark.parametrize("text", ["", "just text", "- a\n- b", "a: [1, 2", "a: 'open", "\ta: 1", "a: &x 1", "a: 1\n   b: 2", "a: {b: 1", "# only", 'a: "\\q"', "a: " + "[" * 5000])
def test_other_texts_give_an_empty_map(text):
    assert fields(text) == {}


def write(root, skill, version, head, assets=(), at=None):
    folder = root / skill / version
    for name in assets:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"\xff" * 3)
    folder.mkdir(parents=True, exist_ok=True)
    if head is not None:
        (folder / "SKILL.md").write_text(head)
        if at:
            os.utime(folder / "SKILL.md", (at, at))


def test_source_gives_the_files_that_the_binary_source_gives(spark, tmp_path):
    bundle_source.register(spark)
    root = tmp_path / "skills"
    write(root, "a", "1", f"---\n{HEAD}---\nBody", ["references/a.md", "x/y/z.txt"])
    write(root, "b", "2", "---\r\nname: named\r\nenabled: 0\r\n---\r\nText")
    write(root, "c", "1", "---\n- no map\n---\nText")
    write(root, "d", "1", "---\nopen: yes\nText")
    got = spark.read.format("skill_bundles").option("skills_per_task", 2).load(f"file://{root}")
    assert got.rdd.getNumPartitions() == 2
    assert sorted(map(str, got.collect())) == sorted(map(str, bundles.files(spark, f"file://{root}").collect()))
    rows = {r.skill_id: r for r in bundles.bundles_of(got).collect()}
    assert [tuple(x) for x in rows["a"].declared_assets] == [("references/a.md", "reference", "long text that goes on"), ("scripts/b.py", "script", None)]
    assert rows["a"].triggers == ["plain one", "it's", "x: y"] and not rows["a"].enabled
    assert rows["b"].display_name == "named" and not rows["b"].enabled
    assert [(r.display_name, r.enabled, r.triggers, r.declared_assets) for r in (rows["c"], rows["d"])] == [("c", True, [], []), ("d", True, [], [])]
    write(root, "e", "1", None, ["only/asset"])
    (root / "f").mkdir()
    assert {r.skill_id for r in spark.read.format("skill_bundles").load(str(root)).select("skill_id").collect()} == set("abcd")
    assert spark.read.format("skill_bundles").load(f"{tmp_path}/nothing").count() == 0


def test_stream_takes_new_versions_once_and_survives_a_restart(spark, tmp_path):
    bundle_source.register(spark)
    root, out = tmp_path / "skills", f"file://{tmp_path}/out"
    write(root, "a", "1", "one", ["n/1.md"], at=1_700_000_000)

    def run():
        read = spark.readStream.format("skill_bundles").load(f"file://{root}")
        query = read.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return sorted((r.skill_id, r.version, r.path) for r in spark.read.parquet(out).collect())

    first = [("a", "1", "SKILL.md"), ("a", "1", "n/1.md")]
    assert run() == first
    assert run() == first
    write(root, "a", "2", "two", at=1_700_000_010)
    write(root, "b", "1", None, ["n/2.md"])  # not published yet
    write(root, "c", "1", "fresh", at=4_000_000_000)  # hasn't settled
    assert run() == sorted([*first, ("a", "2", "SKILL.md")])
    write(root, "b", "1", "now", at=1_700_000_020)
    assert run() == sorted([*first, ("a", "2", "SKILL.md"), ("b", "1", "SKILL.md"), ("b", "1", "n/2.md")])
