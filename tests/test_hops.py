"""Questions of two and three steps on literal evidence; the query against what its texts were made from."""

from pyspark.sql import functions as F

from fathomlake.operators import hops
from fathomlake.plans import steps

ASKED = [
    (1, "How old was Stephen Baldwin when Hailey and Justin got married?", "Hailey Baldwin was born November 22, 1996. Stephen Baldwin was born May 12, 1966. Hailey Baldwin and Justin Bieber married on September 13, 2018. Their wedding ceremony was held on September 30, 2019. Hailey was 22.", "52", None),
    (2, "What year did Yohji Yamamoto's mother sell her dressmaking shop?", "She sold the dressmaking shop in 1972 to fund the launch. In 1977 he launched the label.", "1972", None),
    (3, "What year did Yohji Yamamoto's mother sell her dressmaking shop?", "Yohji Yamamoto was born in 1943. His mother opened a dressmaking shop in Kabukicho.", None, "Yohji Yamamoto's mother sold her dressmaking shop year"),
    (4, "What's the current Tomatometer score of the most recent season of The Rings on Rotten Tomatoes?", "Season 1 Tomatometer 84%. Season 2 Tomatometer 85%. Season 3 has not premiered.", "85%", "The Rings season 3 rotten tomatoes"),
    (5, "What's the current Tomatometer score of the most recent season of The Rings on Rotten Tomatoes?", "The show has 2 seasons and no critic score is printed.", None, "The Rings season 2 rotten tomatoes"),
    (6, "If the Great North Run took place on York's Medieval Walls how many circuits of them would the athletes run? Round to the nearest tenth of a circuit.", "The Great North Run is 13.1 miles. York Medieval Walls stretch 2.11 miles around the city.", "6.2", None),
    (7, "If the Great North Run took place on York's Medieval Walls how many circuits of them would the athletes run? Round to the nearest tenth of a circuit.", "York city walls are 2.11 miles (3.40 kilometres) in the north of England. The Great North Run covers 13.1 miles.", "6.2", None),
    (8, "What attraction in Walt Disney World opened exactly 50 years after the theme park originally opened?", "Walt Disney World opened on October 1, 1971.", None, "Walt Disney World opened October 1, 2021"),
    (9, "What attraction in Walt Disney World opened exactly 50 years after the theme park originally opened?", "Walt Disney World opened on October 1, 1971. Remy's Ratatouille Adventure opened there on October 1, 2021.", "Remy's Ratatouille Adventure", None),
    (10, "Who was team captain of the team that won the Stanley Cup the year Connor McDavid was born?", "Connor McDavid was born on January 13, 1997.", None, "team captain of the team that won the Stanley Cup 1997"),
    (11, "In what century was the current name of this day chosen?", "The name Prinsjesdag was chosen in 1814.", "the 19th century", None),
    (12, "In what century was the current name of this day chosen?", "Prinsjesdag originally was a birthday in the 18th century. The current name was chosen in the 19th century.", "the 19th century", None),
    (13, "In what century was the current name of this day chosen?", "The tradition dates to the 18th century.", None, None),
    (14, "How old was Ada Bell when Tom and Ruth got married?", "Ada Bell was born 3 March 1950. Tom Reed and Ruth Vance married in 1990.", "39 or 40", None),
    (15, "How long has Ian Moss been the CEO?", "Ian Moss has been CEO since April 2, 2015. He joined in 2001.", "9", None),
    (16, "How long has Ian Moss been the chairman?", "Ian Moss became chairman in 2012.", "about 12", None),
    (17, "Why is the sky blue?", "It opened on May 1, 1990.", None, None),
    (18, "What year did the shop open?", "", None, "the shop opened year"),
]
NOW = "2024-09-01"


def frames(spark):
    questions = spark.createDataFrame([(i, i, q) for i, q, *_ in ASKED], "q int, s int, question string")
    return questions, spark.createDataFrame([(i, 1, t) for i, _, t, *_ in ASKED], "s int, source int, text string")


def test_answers(spark):
    got = {r.q: r for r in hops.answers(*frames(spark), "q", "question", "s", "source", "text", F.lit(NOW).cast("date")).collect()}
    assert {k: r.lead for k, r in got.items()} == {i: lead for i, _, _, lead, _ in ASKED if lead}
    assert got[1].said == ["Stephen Baldwin was born May 12, 1966.", "Hailey Baldwin and Justin Bieber married on September 13, 2018."]
    assert all(any(s in t for t in [ASKED[k - 1][2]]) for k, r in got.items() for s in r.said)


def test_next_searches(spark):
    got = {r.q: r.search for r in hops.next_searches(*frames(spark), "q", "question", "s", "source", "text").collect()}
    assert got == {i: search for i, _, _, _, search in ASKED if search}


def test_first_searches(spark):
    rows = frames(spark)[0].select("q", hops.first_searches(F.col("question")).alias("s")).collect()
    got = {r.q: r.s for r in rows}
    assert got[1] == ["Stephen Baldwin date of birth", "Hailey and Justin got married date"]
    assert got[6] == ["the Great North Run distance", "York's Medieval Walls length"]
    assert got[8] == ["Walt Disney World opening date"] and got[10] == ["Connor McDavid birth year"]
    assert got[4] == ["The Rings rotten tomatoes tomatometer"] and got[17] == [] and got[2] == []


def test_three_steps_by_binding(spark):
    """A birth year binds the question, the bound question finds the team, the team finds its captain."""
    questions, evidence = frames(spark)
    bound = hops.next_searches(questions.where("q = 10"), evidence, "q", "question", "s", "source", "text").collect()[0].search
    facts = ["In 1997 the Detroit Red Wings won the Stanley Cup.", "Steve Yzerman was team captain of the Detroit Red Wings.", "In 1998 another team won the Stanley Cup."]
    year = bound.split()[-1]
    team = next(f for f in facts if year in f and "Stanley Cup" in f)
    assert any(name in f for f in facts if "captain" in f for name in ["Detroit Red Wings"] if name in team)


def test_query_answers_what_its_texts_say(spark):
    got = steps.hop_answers(spark, "/root/testdata/sf0.001").collect()
    want = {r.q_id: r.lead for r in steps.expected(spark, "/root/testdata/sf0.001").collect()}
    assert {r.q_id: r.lead for r in got} == want and len(want) > 100


def test_a_year_inside_a_name_is_not_the_year(spark):
    rows = spark.createDataFrame([(1, "Who won the cup the year Ann Bell19500 was born?", "Ann Bell19500 was born in 1950."), (2, "Who won the 1950 cup the year Ann Moss was born?", "Ann Moss was born in 1950.")], "q int, question string, text string").withColumns({"s": F.col("q"), "source": F.lit(1)})
    got = {r.q: r.search for r in hops.next_searches(rows, rows, "q", "question", "s", "source", "text").collect()}
    assert got == {1: "Who won the cup 1950"}
