from pyspark.sql import functions as F

from lamina.functions import text as X


def apply(spark, f, *values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    got = apply(spark, X.normalize, "a\r\nb\rc", "photo-\nsynthesis", "a  b \t c  \n\n\n\nd\f", "  ", "x  \ny")
    assert got == ["a\nb\nc", "photosynthesis", "a b c\n\nd", "", "x\ny"]


def test_headings(spark):
    lines = ["# Cells", "#Cells", "3.2. Cell Division", "3.2 Cell Division", "1) Start", "CELL BIOLOGY", "ABC", "Cell biology", "####### x", "PART 1: THE CELL", "A" * 62]
    assert apply(spark, X.is_heading, *lines) == [True, False, True, False, True, True, False, False, False, True, False]
    assert apply(spark, X.is_heading, "# A\nb") == [False]


def test_sentences(spark):
    assert apply(spark, X.sentences, 'One. Two! "Three" e.g. four? (Five)', "no end") == [["One.", "Two!", '"Three" e.g. four?', "(Five)"], ["no end"]]


def test_fingerprint(spark):
    a, b, c = apply(spark, X.fingerprint, " Page 3 ", "page 47", "Page three")
    assert a == b == "page #" and c != a


def test_tokens_normal_form_collapse(spark):
    assert apply(spark, X.estimate_tokens, "", "a" * 7, "a" * 35) == [1, 2, 10]
    assert apply(spark, X.normal_form, "  What's UP, doc?! ", "...", "naïve\tÉcole_1") == ["what s up doc", "", "naïve école_1"]
    assert apply(spark, X.collapse, " a\n\tb ", "") == ["a b", ""]


def test_paragraphs_and_blocks(spark):
    assert apply(spark, X.paragraphs, "a\n\n b \n\n\n\nc", "# H\ntext\nmore\n# I\nx", "", "one") == [["a", "b", "c"], ["# H\ntext\nmore", "# I\nx"], [], ["one"]]
    blocks = lambda c: X.heading_blocks(X.paragraphs(c))
    assert apply(spark, blocks, "# A\n\n## B\n\ntext\n\nmore\n\n# End", "# A\n\n# B") == [["# A\n## B\n\ntext", "more", "# End"], ["# A\n# B"]]


def test_labels_quotes_tags_suffix(spark):
    row = spark.range(1).select(
        X.page_label(F.lit(2), F.lit(2)).alias("a"), X.page_label(F.lit(2), F.lit(5)).alias("b"), X.quoted(F.lit('say "x"'), ",").alias("c"), X.quoted(F.lit("a,b"), "\t").alias("d"),
        X.card_tags(F.lit("cloze"), F.lit("hard"), F.lit(" Cell  Biology ")).alias("e"), X.suffix(F.lit("dir.x/Notes.MD")).alias("f"), X.suffix(F.lit("dir.x/notes")).alias("g"),
    ).first()
    assert tuple(row) == ("p. 2", "pp. 2-5", '"say ""x"""', "a,b", "cloze hard Cell__Biology", ".md", "")
