import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup, scoring, text
from gleaner.functions.frontmatter import parse_yaml

C = F.col("c")
DAY = 86_400_000
NOW = 1_700_000_000_000


@pytest.mark.parametrize("raw, yaml, body", [("---\na: 1\n---\nhello", "a: 1", "hello"), ("no fence", None, "no fence"), ("---\n---\nx", None, "---\n---\nx"), ("---\r\na: 1\r\n---\r\nx", "a: 1", "x"), ("x\n---\na: 1\n---\n", None, "x\n---\na: 1\n---\n")])
def test_frontmatter_parts(column, raw, yaml, body):
    got = column(text.frontmatter_parts(C), c=raw)
    assert (got.yaml, got.body) == (yaml, body)


def test_yaml_keeps_dates_and_words_as_text():
    assert parse_yaml("created: 2025-01-15\nflag: no\nn: 12\nt: true\nclock: 12:30:00\nlist: [a, b]") == '{"created": "2025-01-15", "flag": "no", "n": 12, "t": true, "clock": "12:30:00", "list": ["a", "b"]}'
    assert parse_yaml("just text") is None and parse_yaml("a: [") is None and parse_yaml(None) is None


def test_sections(column):
    got = column(text.sections(C), c="# Title\nIntro\n## Section 1\nOne\n##### deep\n## Empty\n## Section 2\nTwo\n# T\r\nkept")
    assert [(s.heading, s.content) for s in got] == [("Title", "Intro"), ("Section 1", "One\n##### deep"), ("Section 2", "Two\n# T\r\nkept")]
    assert [(s.heading, s.content) for s in column(text.sections(C), c="plain body")] == [(None, "plain body")]
    assert column(text.sections(C), c="") == []


def test_title_falls_back(column):
    title = text.title(F.col("m"), C)
    assert column(title, m='{"title":"A","name":"B"}', c="# H") == "A"
    assert column(title, m='{"title":"","name":"B"}', c="# H") == "B"
    assert column(title, m='{"identifier":"X-1"}', c="# H") == "X-1"
    assert column(title, m='{"identifier":"X-1","title":""}', c="# H") == "X-1: "
    assert column(title, m=None, c="text\n# H1 \n## H2") == "H1"
    assert column(title, m=None, c="## H2") is None


def test_paragraphs_merge_and_long_ones_split_with_overlap(column):
    small = "\n\n".join(["a" * 700, "b" * 700, "c" * 700])
    assert [len(x) for x in column(text.paragraph_chunks(C), c=small)] == [1402, 700]
    sentence = "word " * 60 + "end."
    chunks = column(text.paragraph_chunks(C), c=" ".join([sentence] * 10))
    assert len(chunks) > 1 and chunks[1].startswith(chunks[0][-200:].strip()[:50]) and all(len(x) <= 1800 for x in chunks)
    assert column(text.paragraph_chunks(C), c="  \n\n ") == []


def test_document_chunks_drop_short_ones_and_carry_context(column):
    body = "# Doc\n" + "x" * 90 + "\n## Tiny\nshort\n## Long\n" + "y" * 100
    got = column(text.document_chunks(F.lit("Doc"), C), c=body)
    assert [(c.section_context, len(c.content)) for c in got] == [("Doc § Doc", len("[Doc § Doc] ") + 90), ("Doc § Long", len("[Doc § Long] ") + 100)]


@pytest.mark.parametrize("raw, want", [("Café résumé", "cafe-resume"), ("hello_world foo", "hello-world-foo"), ("  A -- B!  ", "a-b"), ("", "")])
def test_slugify(column, raw, want):
    assert column(text.slugify(C), c=raw) == want


def test_slugs_of_marked_letters(column):
    for raw, want in (("Tiếng Việt", "tieng-viet"), ("Ångström ǅ Ḟoo", "angstrom-foo"), ("ﬁ ½ x²", "x"), ("İstanbul", "istanbul"), ("Ｋ", "")):
        assert column(text.slugify(C), c=raw) == want, raw
    assert column(text.unique_slug(C, F.lit("a-b")), c="x" * 100) == "x" * 77 + "-ab"


def test_names(column):
    assert column(text.unique_slug(C, F.lit("abc-def-123-456")), c="Hello World") == "hello-world-abcdef12"
    assert column(text.sanitize_filename(C), c='file/name:with*bad"chars') == "file_name_with_bad_chars"
    assert column(text.slugify(C), c="x" * 100) == "x" * 80
    assert [column(text.format_bytes(F.col("n")), n=n) for n in (12, 1536, 5 * 1048576)] == ["12 B", "1.5 KB", "5.0 MB"]


@pytest.mark.parametrize("raw, want", [
    ("<p>Hello <b>world</b></p>", "Hello world"), ("&amp; &lt; &gt; &quot; &#39; &nbsp;", "& < > \" '"), ("Line 1<br>Line 2<br/>Line 3", "Line 1\nLine 2\nLine 3"), ("&#169; &#8212;", "© —"),
    ("<style>p{}</style><!-- x -->a<script>y()</script>b", "ab"), ("&amp;lt;", "<"), ("a&copy;b", "ab"), ("&#x41;", "&#x41;"),
])
def test_strip_html(column, raw, want):
    assert column(markup.strip_html(C), c=raw) == want


def test_quotes_and_threads(column):
    assert column(markup.remove_quoted_replies(C), c="keep\n> quoted\n  > too\nmore\nOn Mon, A wrote:\nlost") == "keep\nmore"
    body = "**From:** a\n**Date:** d\n**Subject:** s\n\nhello\n---\nnot a break\n---\n**From:** b\n\nbye"
    parts = column(markup.thread_messages(C), c=body)
    assert len(parts) == 2
    block = column(markup.message_block(C), c=parts[0])
    assert (block["from"], block["date"], block["subject"], block["body"]) == ("a", "d", "s", "hello\n---\nnot a break")


def test_mail_chunks_number_parts_before_short_ones_go(column):
    chunks = lambda body: column(markup.message_chunks(C, F.lit("S"), F.lit("me"), F.lit("now")), c=body)
    assert chunks("short") == []
    assert [c.section_context for c in chunks("x" * 100)] == ["S § me @ now"] and chunks("x" * 100)[0].content.startswith("[S § me @ now]\n")
    assert [c.section_context for c in chunks("a" * 1400 + "\n\n" + "b" * 1400)] == ["S § me @ now (part 1)", "S § me @ now (part 2)"]


@pytest.mark.parametrize("meta, want", [('{"threadId":"t","messageCount":2}', "thread"), ('{"threadId":"t","messageCount":"2","id":"i"}', "message"), ('{"thread_id":"t","message_count":2}', None), (None, None)])
def test_mail_format(column, meta, want):
    assert column(markup.mail_format(C), c=meta) == want


@pytest.mark.parametrize("raw, want", [
    ("1700000000", 1_700_000_000_000), ("1700000000000", 1_700_000_000_000), ("2025-01-15", 1_736_899_200_000), ("2025-01-15T10:00:00.000Z", 1_736_935_200_000), ("Wed, 15 Jan 2025 10:00:00 +0000", 1_736_935_200_000), ("soon", None), (None, None),
])
def test_parse_timestamp(column, raw, want):
    assert column(scoring.parse_timestamp(C), c=raw) == want


def test_content_timestamp_takes_the_first_parseable(column):
    ts = scoring.content_timestamp(C, F.col("m"))
    assert column(ts, c='{"date":"2025-01-15","created_at":"bad"}', m=5.5) == 1_736_899_200_000
    assert column(ts, c='{"updatedAt":1700000000,"date":"2025-01-15"}', m=5.5) == 1_700_000_000_000
    assert column(ts, c='{"ts":"2025-01-15"}', m=5.5) == 5 and column(ts, c=None, m=7.9) == 7


def test_recency_and_age(column):
    boost = scoring.recency_boost(F.col("t"), NOW)
    assert [round(column(boost, t=NOW - d * DAY), 4) for d in (-1, 0, 90, 180)] == [1.0, 1.0, 0.5, 0.3333]
    assert column(scoring.recency_boost(F.lit(None).cast("long"), NOW)) == 1.0
    assert round(column(scoring.recency_weighted(F.lit(0.8), boost, 0.15), t=NOW - 90 * DAY), 4) == 0.74
    assert [column(scoring.relative_age(F.col("t"), NOW), t=NOW - d * DAY) for d in (-1, 0, 1, 15, 90, 362, 400)] == ["just now", "today", "1d ago", "15d ago", "3mo ago", "0y ago", "1y ago"]


@pytest.mark.parametrize("meta, filters, want", [
    ('{"priority":1}', {"priority": "1"}, True), ('{"a":"X","b":"y"}', {"a": "x", "b": "Y"}, True), ('{"a":"x"}', {"a": "x", "b": "y"}, False), ("broken", {"a": "x"}, False), (None, {"a": "x"}, False), (None, {}, True), ('{"t":["a","b"]}', {"t": "A,B"}, True), ('{"last-reviewed":"z"}', {"last-reviewed": "z"}, True),
])
def test_filters(column, meta, filters, want):
    assert column(scoring.matches_filters(C, filters), c=meta) is want
    assert scoring.parse_filter("k=a=b") == ("k", "a=b") and scoring.parse_filter("none") is None


def test_yaml_of_plain_texts_is_read_by_the_fast_loader_alike(monkeypatch):
    import yaml

    from gleaner.functions import frontmatter as M

    plain = ["n: 1\nday: 2024-01-02\nyes: no\ntags: [a, b]\ntext: 'x: y'\n", "a: {b: 0o17, c: 1_0}\nd: &x [1.5, ~]\ne: *x", "just words", "a: [", "é: ü", "a: \"\\u00e9\""]
    odd = ["a: b \t", "a: !", "a: |\n  x\n", "\ufeffa: 1", "a: " + "[" * 5000]
    asked = []
    real = yaml.load
    monkeypatch.setattr(M.yaml, "load", lambda text, Loader: (asked.append(Loader), real(text, Loader=Loader))[1])
    got = [M.parse_yaml(t) for t in plain]
    assert asked == [M._Fast] * len(plain) and got[0] == '{"n": 1, "day": "2024-01-02", "yes": "no", "tags": ["a", "b"], "text": "x: y"}'
    monkeypatch.setattr(M, "_Fast", M._Core)
    assert got == [M.parse_yaml(t) for t in plain]
    assert not any(M._ALIKE.fullmatch(t) for t in odd)


def test_times_are_taken_from_metadata_that_is_read_once(spark, column):
    from gleaner.functions import scoring

    made = scoring.content_timestamp(F.col("m"), F.col("t"))
    for m, want in (('{"date":"2024-01-02","updatedAt":"no time"}', 1_704_153_600_000), ('{"createdAt":1700000000,"date":"2020-01-01"}', 1_700_000_000_000), ('{"date":null}', 7), ("{", 7), (None, 7)):
        assert column(made, m=m, t=7) == want
    plan = spark.createDataFrame([("{}", 7)], "m string, t long").repartition(2).select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "array(from_json" in plan and plan.count("from_json") == 1


def test_ends_are_looked_at_before_a_text_is_searched(spark):
    """`trim` is `strip`, blanks are told as by `strip`, and lines are judged without copies."""
    blanks = ["", " ", " ", "﻿\n", "\t\x0b", "　", " "]
    rows = [(a + m + b,) for a in blanks for b in blanks for m in ("", "x", "x  y", "é😀")] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    assert df.where(~text.trim(F.col("c")).eqNullSafe(text.strip(F.col("c"))) | ~text.is_blank(F.col("c")).eqNullSafe(text.strip(F.col("c")) == "")).count() == 0
    said = [("a\n > b\n \tc\n  On Monday x wrote:  \ngone",), ("﻿On y wrote:",), ("On a wrote:\nb",), (None,)]
    got = [r[0] for r in spark.createDataFrame(said, "c string").select(markup.remove_quoted_replies(F.col("c"))).collect()]
    assert got == ["a\n \tc", "", "On a wrote:\nb", None]
