import pytest

from quillon.functions import text as T
from quillon.operators import extraction as X

CLAIM = "Use /claim to claim land. Then use /trust to add friends."
NEED = "To create a nation you must be a mayor and have at least $125 000 in-game money."
FAIL = "Failure to afford nation upkeep results in bankrupt nations losing everything."
PERKS = "Stars\n| 1🌟 | None | silk touch spawners and a kit |\n| 5🌟 | 20 quartz blocks, $5,500,000 | access to the nether and the end |\n| 7🌟 | $900 and 7 items | hopper filters for shops |"
LEVELS = "Town level\n| Large Town | 20 | 4 | 500 bonus claims |\n| Metropolis | 24 | 5 | 900 bonus claims |"
DETONATE = "| Detonate | 1,000,000$ |\n| Detonate | Chance to excavate a three by three area |"
ENCHANT = "Custom enchantments allow you to upgrade your tools beyond vanilla.\nTo enchant an item, open your inventory and drag the book on it."
TOWN = "To create a town, type /t new [name] and pay the fee.\n| /town | Shows the town screen |\n| Shows /town commands |"


@pytest.fixture(scope="module")
def answers(spark):
    cases = [
        ("how to claim land", [("Fluff cosmetics are visual only and never change gameplay.", 0.95), (CLAIM, 0.60)]),
        ("banana telescope", [("Spawn warp: use /warp spawn for the main city hub.", 0.81)]),
        ("how do i create a nation", [(NEED + "\n" + FAIL, 0.666)]),
        ("how do i create a nation", [(NEED + " Then create the nation and type /n new [Nation Name].", 0.71)]),
        ("what is nation creation cost", [("Creation takes $125 000 in-game money for a nation.\n" + FAIL, 0.69)]),
        ("hello", []),
        ("what do i get in star rank 5", [(PERKS, 0.5)]),
        ("what perk i get from star rank 1", [(PERKS, 0.5)]),
        ("what do i need for star 7", [(PERKS, 0.4)]),
        ("what is town level metropolis", [(LEVELS, 0.6)]),
        ("what do detonate do", [(DETONATE, 0.6)]),
        ("whats the price for detonate", [(DETONATE, 0.6)]),
        ("how do i create a town", [(TOWN, 0.6)]),
        ("what is custom enchant", [(ENCHANT, 0.6)]),
        ("how do i enchant an item", [(ENCHANT, 0.6)]),
        ("how can i go to end", [("The End. Player-made explosions have been disabled.", 0.62)]),
        ("how much is town upkeep", [("Town upkeep costs $100 a day for each chunk claimed.", 0.5)]),
        ("how do i claim a land", [("Use the plugin to claim and secure your land quickly.", 0.415), ("Stand in the chunk and type /t claim there.", 0.495)]),
    ]
    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query_id long, query string")
    r = spark.createDataFrame([(i, p, s, t) for i, c in enumerate(cases) for p, (t, s) in enumerate(c[1], 1)], "query_id long, pos int, score double, text string")
    got = {x.query_id: x.answer for x in X.extractive_answers(r, q, 248).collect()}
    assert len(got) == len(cases)
    return [got[i] for i in range(len(cases))]


def test_prose(answers):
    assert "claim land" in answers[0]
    assert answers[1] == answers[5] == answers[15] == T.UNKNOWN_REPLY
    assert "mayor" in answers[2] and "Failure" not in answers[2]
    assert "mayor" in answers[3] and "/n new" in answers[3]
    assert "125 000" in answers[4]
    assert "/t claim" in answers[17]


def test_tables(answers):
    assert "access to the nether" in answers[6] and answers[6].startswith("Wiki says: 5")
    assert "silk touch" in answers[7] and "hopper filters" in answers[8]
    assert answers[9].startswith("Wiki says: Metropolis")
    assert "excavate" in answers[10] and "1,000,000" not in answers[10] and answers[10].startswith(X.PREFIX)
    assert answers[11].startswith(X.PRICE_PREFIX) and "1,000,000" in answers[11]
    assert "/t new" in answers[12]
    assert "allow" in answers[13] and "open your inventory" in answers[14]
    assert not answers[16].startswith(X.PRICE_PREFIX) and "$100" in answers[16]


def test_context(spark):
    r = spark.createDataFrame([(1, p, 0.5, "a.md", "T", ["H", "I"] if p == 1 else [], "word " * 20) for p in (1, 2, 3)], "query_id long, pos int, score double, source_path string, title string, heading_path array<string>, text string")
    whole = X.build_context(r, 5000).first().context.split("\n\n")
    assert len(whole) == 3 and whole[0].startswith("[Wiki chunk 1] source=a.md score=0.500\nTitle: T\nHeading: H > I\nText: word") and "Heading: T" in whole[1]
    n = len(whole[0])
    cut = X.build_context(r, n + 2 + 130).first().context.split("\n\n")
    assert len(cut) == 2 and cut[1].endswith("…") and len(cut[1]) <= 130
    assert X.build_context(r, n + 60).first().context == whole[0]


def test_candidate_texts(spark):
    q = spark.createDataFrame([(1, "claim land"), (2, "x"), (3, "y")], "query_id long, query string")
    r = spark.createDataFrame([(1, 1, 0.5, CLAIM), (2, 1, 0.5, "tiny")], "query_id long, pos int, score double, text string")
    got = {x.query_id: x.texts for x in X.candidate_texts(r, q, 1).collect()}
    assert got == {1: ["Use /claim to claim land."], 2: ["tiny"], 3: []}
    assert [x["rank"] for x in X.debug_candidates(X.rank_candidates(X.candidates(r, X.with_flags(q)))).collect()] == [1, 2]
