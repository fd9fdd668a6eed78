import pytest
from compare import connect, difference

from matchlens.plans import catalog

SF = "/root/testdata/sf0.001"
ALL = catalog.spark_queries()
CHECKS = catalog.check_queries()


# Hand-worked answers need enough rows to meet every sample cell.
WIDE = ("p12_match_report", "p13_match_lineups_by", "n7_", "n10_heights", "n11", "n12", "n15", "n16", "n17", "n18", "n19", "n20", "p14_play")


@pytest.fixture(scope="module")
def duck():
    return {sf: connect(sf) for sf in (SF, SF.replace("0.001", "0.01"))}


@pytest.mark.parametrize("name", list(ALL))
def test_matches_plain_sql(spark, duck, name):
    sf = SF.replace("0.001", "0.01") if name.startswith(WIDE) else SF
    df = ALL[name](spark, sf)
    assert (difference(df, duck[sf], CHECKS[name]) if name in CHECKS else df.count() and "") == ""


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(ALL)
    assert set(ALL) - set(CHECKS) == {"c12_scouting_prose"}


def test_registry_names_the_tools():
    from matchlens.plans.registry import TOOLS

    assert len(TOOLS) >= 22


def test_tools_take_caller_words(spark):
    from matchlens.plans.registry import UnknownTeam, call

    t = catalog.open_tables(spark, SF)
    assert {r.team for r in call("game_highs", t, team="the nation 7 university", season=1998).collect()} == {"NATION_7"}
    assert {r.position for r in call("leaderboard", t, position="setter", class_year="freshman", season=1998).collect()} <= {"S"}
    report = call("team_scouting_report", t, team="N-3", season=1998).first()
    assert report.profile[0].startswith("NATION_3") and report.keys[0].startswith("How to beat NATION_3")
    day = t.contests.filter("date like '1998-%'").first()["date"][:10]
    assert call("games_on_date", t, date=day).count() > 0
    with pytest.raises(UnknownTeam):
        call("team_schedule", t, team="nowhere at all")
    with pytest.raises(KeyError):
        call("drop_tables", t)
