import pytest
from pyspark.sql import functions as F

from corpusmill.functions import lexicons as lx, prompts, text as tx


def run(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [
    ("  a \n\t b  ", "a b"), (None, ""), ("", "")])
def test_squeeze(spark, given, want):
    assert run(spark, given, tx.squeeze_ws) == want


def test_question_words_need_boundaries_of_any_script(spark):
    assert run(spark, "what éwhat whatever Who", tx.mark_question_words) == "WHAT éwhat whatever WHO"


def test_code_spans_round_trip_and_share_an_index(spark):
    text = "use `a b` then `c` and `a b`."
    assert run(spark, text, tx.mask_code_spans) == "use <CODE0> then <CODE1> and <CODE0>."
    assert run(spark, text, lambda c: tx.restore_code_spans(tx.mask_code_spans(c), tx.code_spans(c))) == text
    assert run(spark, "no code", tx.mask_code_spans) == "no code"


def test_evaluative_spans_are_upper_cased_in_place(spark):
    assert run(spark, "a very good idea, need  to act", tx.mark_evaluative) == "a VERY GOOD idea, NEED  TO act"


def test_preserve_terms(spark):
    assert run(spark, "The TCP and Zero-Day of DNSx", tx.preserve_terms) == "the TCP and ZERO-DAY of dnsx"


@pytest.mark.parametrize("given, want", [
    ("I don't, won't or can't", "I do not, will not or cannot"), ("let's see that's it", "let us see that is it"),
    ("we'll they've I'd you're I'm", "we will they have I would you are I am"), ("Anna's isn't", "Anna's is not"),
    ("no quotes", "no quotes"), ("'quoted' 're", "'quoted' 're")])
def test_contractions(spark, given, want):
    assert run(spark, given, tx.expand_contractions) == want


def test_possessive_on_request(spark):
    assert run(spark, "Anna's here", lambda c: tx.expand_contractions(c, possessive=True)) == "Anna is here"


def test_urls_and_emails(spark):
    assert run(spark, "see HTTPS://a.b/c?d=1 or me@x.org", tx.mask_urls_emails) == "see <URL> or <EMAIL>"


def test_punctuation(spark):
    assert run(spark, "what?!! a~b (c)d", tx.normalize_punct) == "what. a b (c) d"


@pytest.mark.parametrize("word, want", [
    ("classes", "class"), ("boxes", "box"), ("churches", "church"), ("women", "woman"), ("cities", "city"),
    ("cats", "cat"), ("glass", "glass"), ("bus", "bus"), ("this", "this"), ("ice", "ice")])
def test_lemma(spark, word, want):
    assert run(spark, word, tx.lemma) == want


def test_lemma_exceptions(spark):
    assert run(spark, "mice", lambda c: tx.lemma(c, {"mice": "mouse"})) == "mouse"


def test_token_filter_depends_on_the_text_type(spark):
    def kept(kind):
        return run(spark, "which of these should the dns and http servers use ?", lambda c: F.array_join(
            tx.filter_tokens_by_class(tx.tokenize(c), kind), " "))

    assert kept("question") == "which of dns http servers use ?"
    assert kept("remarks") == "of should the dns and http servers use ?"
    assert kept("general") == "of the dns and http servers use ?"


def test_clean_question(spark):
    out = run(spark, "What's  the DNS (see http://x.org/a)?", lambda c: tx.clean_qa_text(c, "question"))
    assert out == "what is DNS ( see <URL>"


def test_protected_spans_survive(spark):
    out = run(spark, "See Section 12, and  NOTE 4!", lambda c: tx.protect_patterns(
        c, [r"\bSection\s+\d+\b"], tx.strip_noise))
    assert out == "see Section 12 and note"


def test_min_word_length_is_exclusive(spark):
    assert run(spark, "a an the word", lambda c: tx.tokenize_filter(c, 2, ("the",))) == ["word"]


def test_tags(spark):
    assert run(spark, "What is DNS, really?", tx.make_tag) == "[ what-is-dns ]"
    assert run(spark, None, tx.make_tag) == "[ unknown-format ]"
    assert run(spark, "What is DNS, really?", lambda c: tx.strip_tags(tx.tag_question(c))) == "What is DNS, really?"


def test_bullets_and_disclaimer(spark):
    assert run(spark, "a 1. b\n\n2. c ", tx.format_bullets) == "a \n1. b\n2. c"
    assert run(spark, "Please CONSULT", tx.append_disclaimer) == "Please CONSULT"
    assert run(spark, "x", lambda c: tx.append_disclaimer(c, ("y",), "!")) == "x!"


def test_first_words_preview_hash(spark):
    assert run(spark, " a  b c", lambda c: tx.first_words(c, 2, "…")) == "a b…"
    assert run(spark, "a b", lambda c: tx.first_words(c, 2, "…")) == "a b"
    assert run(spark, "abcdef", lambda c: tx.preview(c, 3)) == "abc..."
    assert run(spark, " ABC ", tx.question_hash) == "90015098"


def test_prompt_needs_its_slots(spark):
    with pytest.raises(ValueError, match="answer"):
        prompts.build_prompt("critique_general", question=F.lit("q"))
    assert run(spark, "q?", lambda c: prompts.build_prompt("train_legal", question=c)) == "Legal Question: q?"


def test_lexicons_have_no_repeats():
    for words in (lx.TECHNICAL_TERMS, lx.CYBER_KEYWORDS, lx.EDUCATION_KEYWORDS, lx.CLOSED_CLASS):
        assert len(words) == len(set(words))


def test_cleaner_looks_each_token_up_once(spark):
    """A token is matched with one pattern at most, not with those of all classes, and a question does not take its whole text apart."""
    docs = spark.createDataFrame([("x",)], "text string")

    def optimized(c):
        return docs.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()

    assert optimized(tx.filter_tokens_by_class(F.split("text", " "))).count("RLIKE") == 1
    assert "regexp_extract_all" not in optimized(tx.first_words("text", 3))


def test_quick_class_filter_equals_the_classes(spark):
    words = ["the", "The", "can", "which", "whose", "CAN", "tcp", "TCP", "is", "<url>", "<URL>", "<CODE1>", "7", "٣", "½", "é", "É", "日", "#", ".", "(", "_", "'", "and",
             "above", "zero-day", "a1", "-", "ought", "cannot", "<the>", "{", "~", "`", "z"]
    tokens = spark.createDataFrame([(words,), ([],), (None,)], "t array<string>")
    for kind in ("question", "remarks", "improvements", "answer", "general"):
        for lexicon in (("the", "can", "#"), lx.TECHNICAL_TERMS):
            quick = tx.filter_tokens_by_class("t", kind, lexicon=lexicon)
            plain = tx.filter_tokens_by_class("t", kind, lambda t: tx.token_class(t, lexicon))
            assert [r.x for r in tokens.select(quick.alias("x")).collect()] == [r.x for r in tokens.select(plain.alias("x")).collect()]


def test_terms_are_marked_beside_any_character(spark):
    """Terms inside other words stay; characters that mark spans inside do not get in the way."""
    def mark(c):
        return tx.preserve_terms(c, ("ip", "ips", "i", "zero-day"))

    assert run(spark, "Ip, ips-I xip IP_ zero-day éip (I)", mark) == "IP, IPS-I xip ip_ ZERO-DAY éip (I)"
    assert run(spark, "a\x01ip\x02 I", mark).replace("\x01", "").replace("\x02", "") == "aIP I"


def test_first_words_of_odd_texts(spark):
    assert run(spark, " \n a\t\tb\x0bc ", lambda c: tx.first_words(c, 2)) == "a b"
    assert run(spark, " a ", lambda c: tx.first_words(c, 1, "…")) == "a"
    assert run(spark, " \n", lambda c: tx.first_words(c, 3, "…")) == ""
    assert run(spark, "w " * 60_000, lambda c: F.length(tx.first_words(c, 50_000, "…"))) == 100_000
