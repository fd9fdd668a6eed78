import os

import pytest
from helpers import rows

from matchlens.operators.cumulative import SeasonView
from matchlens.operators.totals import season_totals
from matchlens.sources import merge
from matchlens.sources.versioned import Conflict, VersionedTable
from matchlens.streaming import jobs
from matchlens.tables import COUNTERS

DDL = "k string, d string, v string"


def made(spark, *triples):
    return spark.createDataFrame(list(triples), DDL)


def table(spark, tmp_path, by, *triples, buckets=16):
    t = VersionedTable(spark, str(tmp_path / "table"), made(spark).schema, by, buckets)
    t.replace_all(made(spark, *triples))
    return t


def files(t):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{t.path}/data") for f in fs if f.startswith("part-")}


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], *[(f"k{i}", "d", "old") for i in range(200)])
    before, live = files(t), t.manifest().live
    merge.replace_stored(t, made(spark, ("k7", "d", "new"), ("k7", "e", "new")), ["k"])
    touched = t.touched(made(spark, ("k7", "d", "")))
    assert len(touched) == 1 and t.changed(1, 2) == touched
    assert {b for b, f in t.manifest().live.items() if f != live[b]} == touched
    assert before < files(t) and len(files(t) - before) == 1
    assert rows(t.read().filter("k = 'k7'"), "d", "v") == [("d", "new"), ("e", "new")] and t.read().count() == 201


def test_a_merge_that_fails_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, ["k"], ("a", "1", "old"), ("b", "1", "old"))

    def lost(self, manifest):
        raise OSError("lost between the data and the manifest")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lost)
        with pytest.raises(OSError):
            merge.replace_stored(t, made(spark, ("a", "1", "new")), ["k"])
    assert rows(t.read()) == [("a", "1", "old"), ("b", "1", "old")] and t.versions() == [1]
    assert len(t.vacuum()) == 1 and rows(t.read(), "v") == [("old",), ("old",)]
    merge.replace_stored(t, made(spark, ("a", "1", "new")), ["k"])
    assert rows(t.read(), "k", "v") == [("a", "new"), ("b", "old")]


def test_a_reader_keeps_its_version_and_a_half_written_manifest_is_none(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], ("a", "1", "old"))
    reader = t.read()
    merge.replace_stored(t, made(spark, ("a", "1", "new")), ["k"])
    assert rows(reader, "v") == [("old",)] and rows(t.read(), "v") == [("new",)] and rows(t.read(1), "v") == [("old",)]
    (tmp_path / "table" / "manifests" / "0000000003.json").write_text('{"version": 3, "li')
    assert rows(t.read(), "v") == [("new",)]


def test_a_merge_is_done_again_on_what_another_committed_first(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], ("a", "1", "old"), buckets=1)
    other = VersionedTable(spark, t.path, t.schema, ["k"], 1)
    once = []

    def how(old, new):
        if not once:
            once.append(merge.replace_stored(other, made(spark, ("b", "1", "theirs")), ["k"]))
        return merge.replace_keys(old, new, ["k"])

    assert t.merge(made(spark, ("c", "1", "ours")), how).version == 3
    assert rows(t.read(), "k", "v") == [("a", "old"), ("b", "theirs"), ("c", "ours")]
    with pytest.raises(Conflict):
        t.merge(made(spark, ("c", "1", "ours")), how, based_on=2)


def test_emptied_buckets_and_null_keys(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], ("a", "1", "x"), (None, "1", "x"))
    t.merge(made(spark, ("a", "", ""), (None, "", "")), lambda old, new: old.filter("k is null"))
    assert rows(t.read(), "k") == [(None,)]
    t.merge(made(spark, (None, "", "")), lambda old, new: old.filter("false"))
    assert rows(t.read()) == [] and t.manifest().live == {}


def test_refresh_reads_days_to_come_and_freezes_the_past(spark, tmp_path):
    old = [("a", "2026-01-01", "old"), ("b", "2026-01-05", "old"), ("n", None, "old")] + [(f"p{i}", f"2025-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "old") for i in range(300)]
    t = table(spark, tmp_path, ["d"], *old, buckets=256)
    live = t.manifest().live
    feed = made(spark, ("a", "2026-01-01", "new"), ("c", "2026-01-05", "new"), ("n", None, "new"))
    for _ in range(2):
        merge.refresh_days(t, feed, ["k", "d"], "d", "2026-01-03", "2026-01-09")
        assert rows(t.read().filter("d > '2026' or d is null"), "k", "v") == [("a", "old"), ("c", "new"), ("n", "old")]
    assert t.read().count() == 303
    assert len({b for b, f in t.manifest().live.items() if live.get(b) != f}) <= 9
    with pytest.raises(ValueError):
        merge.refresh_days(t, feed, ["k"], "d", "2026-01-03", "2026-01-09")


def test_upsert_and_prune_leaves_teams_out_of_the_feed(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], ("a", "1", "old"), ("a", "2", "old"), ("b", "1", "old"))
    merge.upsert_and_prune(t, made(spark, ("a", "1", None), ("a", "3", "new")), ["k"], ["k", "d"], {"v": merge.KEEP_NEW})
    assert rows(t.read()) == [("a", "1", "old"), ("a", "3", "new"), ("b", "1", "old")]
    with pytest.raises(ValueError):
        merge.replace_stored(t, made(spark, ("a", "1", "x")), ["d"])


def test_a_batch_sent_twice_is_merged_once(spark, tmp_path):
    t = table(spark, tmp_path, ["k"], buckets=4)
    sink = jobs.newest_sink(t, ["k"], merge.F.col("d"))
    for batch, number in ((made(spark, ("a", "2", "x"), ("b", "1", "x")), 0), (made(spark, ("a", "3", "lost?")), 0), (made(spark, ("a", "1", "older"), ("b", "5", "y")), 1)):
        sink(batch, number)
    # The second batch 0 is taken for a repeat, and an older row never replaces a newer one.
    assert rows(t.read()) == [("a", "2", "x"), ("b", "5", "y")] and t.versions() == [1, 2, 3]


# --- season view -----------------------------------------------------------------------------------


def lines(spark, *given):
    """(contest, player, team, kills, aces)"""
    ddl = "contest_id string, player_id bigint, team_id int, season int, sets double, " + ", ".join(f"{c} double" for c in COUNTERS)
    return spark.createDataFrame([(c, p, team, 2026, 3.0, *[{"kills": k, "aces": a}.get(x) for x in COUNTERS]) for c, p, team, k, a in given], ddl)


def same(view, box):
    cols = ["player_id", "season", "team_id", "gp", "sp", "kills", "aces", "digs", "hit_pct", "kills_per_set"]
    return rows(view.read(), *cols) == rows(season_totals(box), *cols)


@pytest.fixture()
def stored_lines(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "lines"), lines(spark).schema, ["contest_id"], 32)
    given = [(f"c{i}", p, 1 + (i + p) % 2, float(i % 5) if i % 3 else None, None if p == 2 else 0.5) for i in range(30) for p in range(4)]
    t.replace_all(lines(spark, *given))
    return t


def test_season_view_follows_insertions_changes_and_deletions(spark, tmp_path, stored_lines):
    view = SeasonView(spark, str(tmp_path / "view"), stored_lines, buckets=8)
    assert view.refresh() == "full" and view.refresh() == "current" and same(view, stored_lines.read())
    # A new match with a new player; figures of a match that change, one becoming unknown; a match that goes.
    merge.replace_stored(stored_lines, lines(spark, ("new", 1, 2, 9.0, 1.0), ("new", 77, 2, None, None)), ["contest_id"])
    assert view.refresh() == "changes" and same(view, stored_lines.read())
    merge.replace_stored(stored_lines, lines(spark, ("c4", 1, 1, None, None), ("c4", 2, 2, 40.0, 2.5)), ["contest_id"])
    stored_lines.merge(lines(spark, ("new", 1, 2, None, None)), lambda old, new: old.join(new.select("contest_id"), "contest_id", "left_anti").select(*old.columns))
    assert view.refresh() == "changes" and same(view, stored_lines.read())
    assert rows(view.read().filter("player_id = 77")) == []


def test_a_box_line_given_twice_does_not_change_the_matches(spark, tmp_path, stored_lines):
    view = SeasonView(spark, str(tmp_path / "view"), stored_lines, buckets=8)
    view.refresh()
    matches = dict(rows(view.read(), "player_id", "gp"))
    stored_lines.merge(lines(spark, ("c4", 1, 1, 3.0, None)), lambda old, new: old.unionByName(new))
    assert view.refresh() == "changes" and same(view, stored_lines.read())
    assert dict(rows(view.read(), "player_id", "gp")) == matches


def test_a_refresh_reads_changed_matches_only(spark, tmp_path, stored_lines, monkeypatch):
    view = SeasonView(spark, str(tmp_path / "view"), stored_lines, buckets=8)
    view.refresh()
    merge.replace_stored(stored_lines, lines(spark, ("c4", 1, 1, 8.0, None)), ["contest_id"])
    asked = []
    real = VersionedTable.read
    monkeypatch.setattr(VersionedTable, "read", lambda self, version=None, only=None: asked.append((version, only)) or real(self, version, only))
    assert view.refresh() == "changes"
    bucket = stored_lines.touched(lines(spark, ("c4", 1, 1, None, None)))
    assert asked == [(1, bucket), (2, bucket)]


def test_season_view_falls_back_to_a_full_sum(spark, tmp_path, stored_lines, monkeypatch):
    view = SeasonView(spark, str(tmp_path / "view"), stored_lines, buckets=8)
    view.refresh()
    for k in range(3):
        merge.replace_stored(stored_lines, lines(spark, (f"c{k}", 1, 1, 50.0 + k, None)), ["contest_id"])
    stored_lines.vacuum(keep=1)
    assert view.refresh() == "full" and same(view, stored_lines.read())
    # Another refresh commits between this one's reading and its commit: the changes are not added twice.
    merge.replace_stored(stored_lines, lines(spark, ("c9", 1, 1, 5.0, None)), ["contest_id"])
    other, first = SeasonView(spark, view.table.path, stored_lines, buckets=8), []
    real = VersionedTable._commit

    def commit(self, manifest):
        if self is view.table and not first:
            first.append(other.refresh())
        return real(self, manifest)

    monkeypatch.setattr(VersionedTable, "_commit", commit)
    assert view.refresh() == "current" and first == ["changes"] and same(view, stored_lines.read())
