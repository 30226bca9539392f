"""Quotation linking on small mail threads."""

from ridgeline.llm import quotes

MAIL = [
    (1, 1, "a", "First line.\nSecond line."),
    (1, 2, "b", "> First line.\n> Second  LINE.\n\nI agree."),
    (1, 3, "c", "> > First line.\n> > Second line.\n> \n> I agree.\n\nNot me."),
    (1, 4, "a", "Top.\n> second line.\nBottom."),  # one line of a passage
    (1, 5, "d", ">nobody wrote this\nnew"),
    (1, 6, "e", ">> I agree.\nskipped a level"),
    (1, 7, "f", None),
    (1, 8, "g", ""),
    (2, 1, "a", "First line.\nSecond line."),  # another thread
    (2, 1, "a", "First line.\nSecond line."),
    (2, 2, "b", "> First line.\n> Second line.\nyes"),
    (None, 1, "a", "> x\nlost"),
    (3, None, "a", "no number"),
    (3, None, "b", "no number"),
    (3, None, "b", "no number"),
    (None, 20, "a", "one of two"),
    (None, 20, "b", "the other"),
    (4, 9, "h", "> Top.\n> Bottom.\nfrom another thread"),
    (4, 10, "h", "> I agree.\nand so does this"),
    (4, 11, "h", "> no number\nof something without a time"),
    (None, 12, "h", "> First line.\n> Second line.\nfirst of all who wrote it"),
    (5, 30, "q", "> Yes.\nAsked what?"),
    (6, 21, "q", "> Shall we go?\nYes."),
    (6, 20, "q", "> Shall we stay?\nYes."),
    (7, 31, "q", "> > Shall we go?\n> Yes.\nThen let us."),
]


def test_threads(spark):
    table = spark.createDataFrame([(*m, 0) for m in MAIL], "thread long, message long, role string, text string, level int")
    rows = quotes.conversations(table).collect()
    assert len(rows) == len(MAIL) - 1  # one repeated row
    assert [r.text for r in rows if r.thread == 3] == ["no number"] * 3
    assert sorted(r.text for r in rows if r.message == 20 and r.thread is None) == ["one of two", "the other"]
    found = {(r.thread, r.message): r for r in rows}
    parents = {k: (r.parent_thread, r.parent) for k, r in found.items() if r.parent is not None}
    assert parents == {
        (1, 2): (1, 1), (1, 3): (1, 2), (1, 4): (1, 1), (1, 6): (1, 2), (2, 2): (2, 1),
        (4, 9): (1, 4), (4, 10): (1, 2), (None, 12): (1, 1), (5, 30): (6, 20), (7, 31): (6, 21),
    }
    assert (found[4, 10].root_thread, found[4, 10].root, found[4, 10].depth) == (1, 1, 2)
    assert {k: (r.root, r.depth) for k, r in found.items() if k[0] == 1 and k[1] in (1, 2, 3, 4, 5, 6)} == {
        (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (1, 4): (1, 1), (1, 5): (5, 0), (1, 6): (1, 2)
    }
    assert [found[1, m].place for m in (1, 2, 3, 4, 6)] == [1, 2, 3, 4, 5]
    assert [found[k].place for k in ((4, 9), (4, 10), (None, 12))] == [6, 7, 8]
    assert found[1, 3].text == "Not me." and found[1, 4].text == "Top.\nBottom." and found[1, 5].text == "new"
    assert (found[1, 3].n_quotes, found[1, 3].n_linked) == (2, 2)
    assert (found[1, 5].n_quotes, found[1, 5].n_linked) == (1, 0)
    assert found[1, 7].text == found[1, 8].text == ""
    assert found[None, 1].parent is None and found[3, None].parent is None


def test_deep_chain_and_long_text(spark):
    rows = [(1, 0, "r", "start " * 20000)]
    rows += [(1, 1, "r", "> " + "start " * 20000 + "\nreply 1")]
    rows += [(1, i, "r", f"> reply {i - 1}\nreply {i}") for i in range(2, 21)]
    found = quotes.conversations(spark.createDataFrame(rows, "thread long, message long, role string, text string"))
    assert [(r.root, r.depth) for r in found.orderBy("message").collect()] == [(0, i) for i in range(21)]


def test_many_lines(spark):
    """Parsing inside a row takes time in proportion to its lines."""
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(20000))
    table = spark.createDataFrame([(1, 1, "a", text)], "thread long, message long, role string, text string")
    parsed = quotes._parsed(table).first()
    assert len(parsed.said) == len(parsed.quoted) == 20000
    assert parsed.own == "\n".join(f"answer {i}" for i in range(20000))


def test_hot_passages_and_conversations(spark, monkeypatch):
    """Spread keys and ranges of a conversation give what whole ones give."""
    rows = [(None, 0, "r", "start")] + [(None, i, "r", f"> start\nreply {i % 7} of {i // 9}") for i in range(1, 150)]
    rows += [(None, 200 + i, "s", f"> reply {i % 7} of {i}\nthanks") for i in range(20)]
    table = spark.createDataFrame(rows, "thread long, message long, role string, text string")
    plain = sorted(map(repr, quotes.conversations(table).collect()))
    monkeypatch.setattr(quotes.skew, "DEFAULT_HOT_ROWS", 10)
    monkeypatch.setattr(quotes, "PLACE_ROWS", 20)
    found = quotes.conversations(table).collect()
    assert sorted(map(repr, found)) == plain
    assert sorted(r.place for r in found if r.root == 0) == list(range(1, sum(r.root == 0 for r in found) + 1))


def test_empty_table(spark):
    table = spark.createDataFrame([], "thread long, message long, role string, text string")
    assert quotes.conversations(table).count() == 0
