import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.fixed_values import STOP_WORDS

from . import plain


def test_stop_words_follow_from_the_public_list(spark):
    public = StopWordsRemover.loadDefaultStopWords("english")
    derived = {w.replace("'", "") for w in public} | {w[:-2] for w in public if w.endswith("n't")}
    derived = (derived - {"just", "now", "s", "t"}) | {"also", "etc", "let", "may", "might", "shall", "us"}
    assert set(STOP_WORDS) == derived and len(STOP_WORDS) == 197


def test_clean_text(column):
    cases = {
        "  Hi   there!\r\n\r\n\r\nA “quoted” word — and it’s – fine.  \t ": 'Hi there!\n\nA "quoted" word - and it\'s - fine.',
        "a\x00b\x07c\x85d\x9fe": "abcde",
        "one\rtwo\r\nthree": "one\ntwo\nthree",
        "tab\t\t x": "tab x",
        "  x　": "x",
        "": "",
        None: "",
    }
    assert column(T.clean_text, list(cases)) == list(cases.values())


def test_cleaning_twice_changes_nothing(column):
    texts = [" a\n\x00\n\n b\r\r\n—“", "x \n \n\n y\t", "  z"]
    once = column(T.clean_text, texts)
    assert column(T.clean_text, once) == once


def test_segmentation(column):
    text = "First one. Second one!\n\nThird here? Yes. \"Quoted.\" 4 more. École. lower. Dr. Smith"
    assert column(lambda c: T.paragraphs(T.clean_text(c)), [text, "", "a\n \n\nb"]) == [
        ["First one. Second one!", "Third here? Yes. \"Quoted.\" 4 more. École. lower. Dr. Smith"], [], ["a", "b"],
    ]
    assert column(lambda c: T.sentences(T.clean_text(c)), [text])[0] == [
        "First one.", "Second one!", "Third here?", "Yes.", '"Quoted." 4 more. École. lower.', "Dr.", "Smith",
    ]


def test_word_tokens(column):
    texts = ["Don't use state-of-the-art café naïve x_y 3rd foo-baré é-bar a--b", "", "12 '34"]
    expected = [plain.words(t) for t in texts]
    assert expected[0][:2] == ["don't", "use"] and "caf" not in expected[0]
    assert column(T.word_tokens, texts) == expected
    assert column(lambda c: T.word_tokens(c, lower=False), ["Don't GO"]) == [["Don't", "GO"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abZ09 -'_\n.éß!?\"", max_size=40), min_size=20, max_size=60))
def test_tokens_equal_plain_python(column, texts):
    assert column(T.word_tokens, texts) == [plain.words(t) for t in texts]
    assert column(lambda c: T.terms(T.without_stop_words(T.keyword_tokens(c))), texts) == [plain.keyword_terms(t) for t in texts]
    assert column(lambda c: T.terms(T.without_stop_words(T.search_tokens(c))), texts) == [plain.search_terms(t) for t in texts]
    assert column(T.classifier_tokens, texts) == [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]


def test_preprocess_for_ml(column):
    assert column(T.preprocess_for_ml, ["The 2024 Grid, the grid's 1st don't go up"]) == ["grid grid's 1st don't"]
    assert column(lambda c: T.preprocess_for_ml(c, ["GRID"]), ["the grid holds"]) == ["holds"]


def test_bigrams_bridge_removed_stop_words(column):
    found = column(lambda c: T.terms(T.without_stop_words(T.keyword_tokens(c))), ["wind of the north", "the", "wind"])
    assert found == [["wind", "north", "wind north"], [], ["wind"]]
    assert column(lambda c: T.terms(F.split(c, " "), (1, 3)), ["a b c"]) == [["a", "b", "c", "a b", "b c", "a b c"]]


def test_highlight_escapes_and_marks(column):
    mark = lambda w: f'<mark class="search-match">{w}</mark>'
    text = "Wind & <b>wind</b> windy don't state-of-art 'x'"
    words = F.array(*[F.lit(w) for w in ("wind", "don't", "state-of-art")])
    assert column(lambda c: T.highlight(c, words), [text]) == [
        f"{mark('Wind')} &amp; &lt;b&gt;{mark('wind')}&lt;/b&gt; windy {mark('don&#x27;t')} {mark('state-of-art')} &#x27;x&#x27;"
    ]
    assert column(lambda c: T.matched_terms(c, words), [text]) == [["don't", "state-of-art", "wind"]]
    nothing = F.array().cast("array<string>")
    assert column(lambda c: T.highlight(c, nothing), ["a<b"]) == ["a&lt;b"]
    assert column(lambda c: T.matched_terms(c, nothing), ["a<b"]) == [[]]


def test_highlight_tokens(column):
    assert column(T.highlight_tokens, ["the Wind a x", "of the"]) == [["wind"], ["of", "the"]]


def test_whole_word_count(column):
    count = lambda phrase: column(lambda c: T.whole_word_count(c, F.lit(phrase)), ["foo foo-bar foobar éfoo foo bar foo.bar"])[0]
    assert count("foo") == 4 and count("foo bar") == 1 and count("foo-bar") == 1 and count("ba") == 0


def test_plain_keyword_test_is_never_wrongly_true(column):
    texts = ["the and of", "the-cat", "cat", "the cat", "ab cd", "the the-ab", "cat-a", "éclair the", "x_cat"]
    certain = column(T.has_plain_keyword, texts)
    for text, sure in zip(texts, certain):
        assert not sure or plain.keyword_terms(text), text
    assert certain[2] and certain[3] and not certain[0]


def test_a_stored_table_can_be_dropped(spark):
    from lexiloom.session import drop_stored, materialize

    table = materialize(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5
    drop_stored(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._stored_at).count()


def test_cleaning_in_steps_gives_what_one_pattern_for_each_gives(spark, column):
    marks = ["a", "B", " ", "  ", "\t", "\n", "\r", "\r\n", "“", "”", "‘", "’", "–", "—", "\x00", "\x08", "\x0b", "\x0c", "\x0e", "\x1f", "\x7f", "\x85", "\x9f", "\xa0", "é", "中", "\U0001f600", "\U0010ffff"]
    odd = ["".join(p) for p in itertools.product(marks, repeat=2)] + ["a\r\r\nb", "a\n\r\n\nb", "a \t\x00 b", "\n \n\n\x07\n\n x", "", None]
    def plain(text):
        c = (text or "").translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": " - ", "—": " - "}))
        c = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", re.sub(r"\r\n?", "\n", c))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", c)).strip(T.WHITE_SPACE)
    assert column(T.clean_text, odd) == [plain(t) for t in odd]


def test_cleaning_replaces_single_characters_without_patterns(spark):
    plan = spark.range(1).select(T.clean_text(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "replace" in plan and "translate" not in plan
