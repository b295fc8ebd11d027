"""Text cleaning as Column expressions; everything stays in the JVM."""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from corpusmill.functions import lexicons as lx

# A word character is any letter, number or underscore of any script.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Possessive, as no match gives a character back.
RUNS = rf"{WORD}++|{NOT_WORD}++"
TOKEN = rf"{WORD}++(?:[-']{WORD}++)*+|<[A-Za-z]+\d*>|[^\s\p{{L}}\p{{N}}_]"
OPEN, CLOSE = "\u0001", "\u0002"

# What counts as a URL, an e-mail, a tag, a number and punctuation.
URL = r"(?i)https?://[!$-_a-z]+"
EMAIL = r"\S+@\S+"
NOISE_URL = r"(?i)http\S+|www\S+"
NOISE_EMAIL = r"\S*@\S*\s?"
NOISE_HTML = r"<[^<]+?>"
NOISE_NUMBER = r"\p{Nd}+"
NOISE_PUNCT = r"[^a-zA-Z\s]"
PUNCT_RUN = r"[.,!?;:]{2,}"
PUNCT_OTHER = r"[^\p{L}\p{N}_\s.,!?;:()\[\]{}\-/\\@#$%^&*+=|<>]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def bounded(pattern: str) -> str:
    """The pattern between word boundaries of any script."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def any_of(phrases: Iterable[str]) -> str:
    """Alternation of literal phrases, longest first."""
    return "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p)))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def squeeze_ws(c: Column | str) -> Column:
    """Null becomes empty, white space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(_col(c), F.lit(r"(\S+)"), F.lit(1))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(c), F.lit(r"\S+")), F.lit(0))


def _upper_runs(c: Column, members: Sequence[str]) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"({RUNS})"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.when(F.lower(w).isin(list(members)), F.upper(w)).otherwise(w)), "")


def upper_spans(c: Column, pattern: str) -> Column:
    """Upper-case every span the pattern matches and nothing else."""
    parts = F.split(F.regexp_replace(c, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    return F.array_join(
        F.transform(parts, lambda p: F.when(
            F.contains(p, F.lit(CLOSE)),
            F.concat(F.upper(F.substring_index(p, CLOSE, 1)), F.substring_index(p, CLOSE, -1)),
        ).otherwise(p)), "")


def mark_question_words(c: Column | str, question_words: Sequence[str] = lx.QUESTION_WORDS) -> Column:
    return _upper_runs(_col(c), question_words)


def question_words_found(c: Column | str, question_words: Sequence[str] = lx.QUESTION_WORDS) -> Column:
    """The marks of C2 as an array, for the composed cleaner."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({WORD}+)"), F.lit(1)),
                    lambda w: w.isin(list(question_words)))


def code_spans(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit("`([^`]+)`"), F.lit(1))


def mask_code_spans(c: Column | str) -> Column:
    """Back-tick spans become <CODEi>; equal spans of a row share the first index."""
    parts = F.struct(F.split(_col(c), "`[^`]+`").alias("pieces"), code_spans(c).alias("spans"))

    def join(v):
        marks = F.transform(v["spans"], lambda s: F.concat(
            F.lit("<CODE"), (F.array_position(v["spans"], s) - 1).cast("string"), F.lit(">")))
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), marks), v["pieces"], lambda m, p: F.concat(m, p)), "")

    return let(parts, join)


def restore_code_spans(c: Column | str, spans: Column | str) -> Column:
    ids = F.regexp_extract_all(_col(c), F.lit(r"<CODE(\d+)>"), F.lit(1))
    parts = F.struct(F.split(_col(c), r"<CODE\d+>").alias("pieces"), ids.alias("ids"), _col(spans).alias("spans"))

    def join(v):
        code = F.transform(v["ids"], lambda i: F.concat(
            F.lit("`"), F.coalesce(F.get(v["spans"], i.cast("int")), F.lit("")), F.lit("`")))
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), code), v["pieces"], lambda m, p: F.concat(m, p)), "")

    return let(parts, join)


def evaluative_pattern(intensifiers: Sequence[str] = lx.INTENSIFIERS, sentiment: Sequence[str] = lx.SENTIMENT_WORDS,
                       modals: Sequence[str] = lx.MODAL_WORDS) -> str:
    phrase = rf"(?:{any_of(intensifiers)})\s+{WORD}+"
    return "(?iu)" + bounded(f"{phrase}|{any_of(tuple(sentiment) + tuple(modals))}")


def mark_evaluative(c: Column | str, **lists: Sequence[str]) -> Column:
    return upper_spans(_col(c), evaluative_pattern(**lists))


def evaluative_spans(c: Column | str, **lists: Sequence[str]) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({evaluative_pattern(**lists)})"), F.lit(1))


def preserve_terms(c: Column | str, lexicon: Sequence[str] = lx.TECHNICAL_TERMS) -> Column:
    """Lower-case text with the lexicon's terms in upper case."""
    single = [t for t in lexicon if re.fullmatch(r"\w+", t)]
    compound = [t for t in lexicon if t not in set(single)]
    out = F.lower(_col(c))
    if single:
        # The terms alone are looked for, by first letter; a text that holds the marks of spans is taken apart into all its runs.
        starts = "|".join(f"{re.escape(k)}(?:{any_of(t[1:] for t in g)})" for k, g in itertools.groupby(sorted(set(single)), lambda t: t[0]))
        out = let(out, lambda t: F.when(F.contains(t, F.lit(OPEN)) | F.contains(t, F.lit(CLOSE)), _upper_runs(t, single))
                  .otherwise(upper_spans(t, bounded(starts))))
    return upper_spans(out, "(?iu)" + bounded(any_of(compound))) if compound else out


def expand_contractions(c: Column | str, table: Mapping[str, str] = lx.CONTRACTIONS,
                        suffixes: Mapping[str, str] = lx.CONTRACTION_SUFFIXES, possessive: bool = False) -> Column:
    """Whole contractions first, then suffixes; possessive 's only on request.

    Only words with an apostrophe are looked at, so text without any passes through.
    """
    tails = {**suffixes, **(lx.POSSESSIVE_SUFFIX if possessive else {})}

    def expand(word):
        for short, full in sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0])):
            word = F.regexp_replace(word, "(?iu)" + bounded(re.escape(short)), full)
        for short, full in sorted(tails.items(), key=lambda kv: (-len(kv[0]), kv[0])):
            word = F.regexp_replace(word, rf"(?iu)(?<={WORD}){re.escape(short)}(?!{WORD})", full)
        return word

    def by_word(t):
        # A word with apostrophes, or anything up to the next one.
        pieces = F.split(F.regexp_replace(t, rf"{WORD}+(?:'{WORD}+)+", f"{OPEN}$0{CLOSE}"), OPEN)
        return F.array_join(F.transform(pieces, lambda p: F.when(F.contains(p, F.lit(CLOSE)), F.concat(
            expand(F.substring_index(p, CLOSE, 1)), F.substring_index(p, CLOSE, -1))).otherwise(p)), "")

    return let(_col(c), lambda t: F.when(F.contains(t, F.lit("'")), by_word(t)).otherwise(t))


def _replace_where(c: Column, part: str, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` of a pattern whose every match holds ``part``: texts without it pass through."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(part)), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def mask_urls_emails(c: Column | str) -> Column:
    return _replace_where(_replace_where(_col(c), "://", URL, "<URL>"), "@", EMAIL, "<EMAIL>")


def normalize_punct(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), PUNCT_RUN, ".")
    out = F.regexp_replace(out, PUNCT_OTHER, " ")
    out = _replace_where(out, "(", r"\s*\(\s*", " (")
    return _replace_where(out, ")", r"\s*\)\s*", ") ")


def tokenize(c: Column | str) -> Column:
    """Placeholders, words (with inner hyphen or apostrophe) and single symbols."""
    return F.regexp_extract_all(_col(c), F.lit(f"({TOKEN})"), F.lit(1))


def _from_letter(t: Column) -> Column:
    """Whether a token begins with a to z: a comparison of bytes, cheaper than a pattern."""
    return (t >= "a") & (t < "{")


def token_class(t: Column, lexicon: Sequence[str] = lx.TECHNICAL_TERMS,
                closed: Sequence[str] = lx.CLOSED_CLASS) -> Column:
    """Word class of one token from closed-class lists; anything else with a letter is content."""
    low, letter = F.lower(t), _from_letter(t)
    return (
        F.when(low.isin(list(lexicon)), "term")
        .when(t.startswith("<") & t.rlike(r"^<(?:URL|EMAIL|CODE\d*)>$"), "placeholder")
        .when(t.isin(list(lx.KEPT_PUNCTUATION)), "punct")
        .when(~letter & t.rlike(r"^\p{Nd}+$"), "digits")
        .when(low.isin(list(lx.MODAL_CLASS)), "modal")
        .when(low.isin(list(lx.WH_DETERMINERS)), "wh_determiner")
        .when(low.isin(list(closed)), "function")
        .when(letter | t.rlike(rf"{WORD}"), "content")
        .otherwise("symbol")
    )


def filter_tokens_by_class(tokens: Column | str, text_type: str = "general", classify: Callable[[Column], Column] | None = None,
                           lexicon: Sequence[str] = lx.TECHNICAL_TERMS) -> Column:
    """Keep the classes that carry meaning for this kind of text; without ``classify`` those of ``token_class`` by the lexicon."""
    kept = ["term", "content", "punct", "digits", "placeholder"]
    if text_type == "question":
        kept.append("wh_determiner")
    if text_type in ("remarks", "improvements"):
        kept.append("modal")
    short = [w for w in lx.SHORT_FUNCTION_WORDS if text_type != "question" or w not in lx.NOT_IN_QUESTIONS]
    if classify is not None:
        return F.filter(_col(tokens), lambda t: classify(t).isin(kept) | F.lower(t).isin(short))
    # The same in one look-up: a token goes that is in the list of a class that is not kept, or has no word character and is not listed.
    listed = {**dict.fromkeys(lx.CLOSED_CLASS, "function"), **dict.fromkeys(lx.WH_DETERMINERS, "wh_determiner"), **dict.fromkeys(lx.MODAL_CLASS, "modal")}
    always = {*lexicon, *short}
    dropped = sorted(w for w, kind in listed.items() if kind not in kept and w not in always)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(dropped) & (
        _from_letter(t) | t.rlike(WORD) | t.isin(list(lx.KEPT_PUNCTUATION)) | F.lower(t).isin(sorted(always))))


# Noun endings and their lemma endings, first match wins.
LEMMA_RULES = (("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"),
               ("ies", "y"), ("s", ""))


def lemma(t: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Noun lemma of one lower-case token by suffix detachment."""
    out = None
    for word, form in (exceptions or {}).items():
        out = F.when(t == word, form) if out is None else out.when(t == word, form)
    keep = t.endswith("ss") | t.endswith("us") | t.endswith("is") | (F.length(t) <= 3)
    out = F.when(keep, t) if out is None else out.when(keep, t)
    for ending, form in LEMMA_RULES:
        out = out.when(t.endswith(ending), F.concat(F.left(t, F.length(t) - len(ending)), F.lit(form)))
    return out.otherwise(t)


def lemmatize(tokens: Column | str, lexicon: Sequence[str] = lx.TECHNICAL_TERMS,
              exceptions: Mapping[str, str] | None = None) -> Column:
    """Lower-case lemma of every token over two characters that is no lexicon term or placeholder."""
    last = sorted({ending[-1] for ending, _ in LEMMA_RULES})

    def one(t, low):
        out = F.when((F.length(t) > 2) & ~low.isin(list(lexicon)) & ~t.startswith("<"), lemma(low, exceptions)).otherwise(t)
        if exceptions:
            return out
        # Most tokens are in lower case and end like no rule: they stay as they are, whatever they are.
        return F.when((t == low) & ~functools.reduce(operator.or_, [low.endswith(x) for x in last]), t).otherwise(out)

    return let(_col(tokens), lambda v: F.zip_with(v, F.transform(v, lambda t: F.lower(t)), one))


def clean_qa_text(c: Column | str, text_type: str = "general", lexicon: Sequence[str] = lx.TECHNICAL_TERMS,
                  exceptions: Mapping[str, str] | None = None) -> Column:
    """The composed cleaner; marks and code spans come from their own projections."""
    out = squeeze_ws(c)
    if text_type == "answer":
        out = mask_code_spans(out)
    out = F.regexp_replace(preserve_terms(out, lexicon), r"<code(\d+)>", "<CODE$1>")
    out = normalize_punct(mask_urls_emails(expand_contractions(out)))
    tokens = filter_tokens_by_class(tokenize(out), text_type, lexicon=lexicon)
    return F.array_join(lemmatize(tokens, lexicon, exceptions), " ")


def strip_noise(c: Column | str, urls: bool = True, emails: bool = True, html: bool = True, numbers: bool = True,
                punct: bool = True) -> Column:
    """Lower-case, then the chosen removals in this order."""
    out = F.lower(_col(c))
    for wanted, pattern in ((urls, NOISE_URL), (emails, NOISE_EMAIL), (html, NOISE_HTML), (numbers, NOISE_NUMBER),
                            (punct, NOISE_PUNCT)):
        if wanted:
            out = F.regexp_replace(out, pattern, "")
    return out


def protect_patterns(c: Column | str, patterns: Sequence[str], clean: Callable[[Column], Column],
                     ignore_case: bool = False) -> Column:
    """Clean the text around the protected spans; the spans come through unchanged."""
    if not patterns:
        return clean(_col(c))
    pattern = ("(?iu)" if ignore_case else "") + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    spans = F.regexp_extract_all(_col(c), F.lit(f"({pattern})"), F.lit(1))
    cleaned = F.transform(F.split(_col(c), pattern), lambda p: clean(p))
    joined = F.zip_with(F.concat(F.array(F.lit("")), spans), cleaned, lambda span, p: F.concat(span, F.lit(" "), p))
    return squeeze_ws(F.array_join(joined, " "))


def tokenize_filter(c: Column | str, min_word_length: int = 2, stopwords: Sequence[str] = (),
                    custom_stopwords: Sequence[str] = ()) -> Column:
    """Tokens longer than ``min_word_length`` (exclusive, D10) that are no stop words."""
    stop = sorted(set(stopwords) | set(custom_stopwords))
    keep = (lambda t: (F.length(t) > min_word_length) & ~t.isin(stop)) if stop else (
        lambda t: F.length(t) > min_word_length)
    return F.filter(tokenize(c), keep)


def cap_length(c: Column | str, n: int | None) -> Column:
    return _col(c) if n is None else F.when(F.length(_col(c)) > n, strip(F.left(_col(c), F.lit(n)))).otherwise(_col(c))


def strip_tags(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"\[.*?\]\s*", ""))


def make_tag(c: Column | str, n: int = 3) -> Column:
    """[ a-b-c ] from the first n words; [ unknown-format ] without a text."""
    first = F.slice(F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({WORD}+)"), F.lit(1)), 1, n)
    return F.when(_col(c).isNull(), "[ unknown-format ]").otherwise(
        F.concat(F.lit("[ "), F.array_join(first, "-"), F.lit(" ]")))


def tag_question(c: Column | str, n: int = 3) -> Column:
    return F.concat_ws(" ", make_tag(c, n), _col(c))


def format_bullets(c: Column | str) -> Column:
    """Numbered items start on their own line; no blank lines."""
    out = F.regexp_replace(_col(c), r"(?<!\n)(\d\.\s)", "\n$1")
    return strip(F.regexp_replace(out, r"\n{2,}", "\n"))


LEGAL_MARKERS = ("not legal advice", "consult")
LEGAL_NOTE = "\n\nNote: this is general information and not legal advice. Please consult a qualified attorney."


def append_disclaimer(c: Column | str, markers: Sequence[str] = LEGAL_MARKERS, note: str = LEGAL_NOTE) -> Column:
    """Add the note where none of the marker phrases occurs."""
    low, absent = F.lower(_col(c)), F.lit(True)
    for m in markers:
        absent = absent & ~low.contains(m)
    return F.when(absent, F.concat(_col(c), F.lit(note))).otherwise(_col(c))


def first_words(c: Column | str, n: int, ellipsis: str = "") -> Column:
    """First n words; the ellipsis only where words were left out. The rest of the text is not taken apart."""
    if n < 1:
        return F.when(_col(c).isNotNull(), F.when(_col(c).rlike(r"\S"), ellipsis).otherwise(""))
    head = rf"^\s*(\S++(?:\s++\S++){{0,{n - 1}}}+)"
    first = F.regexp_replace(F.regexp_extract(_col(c), head, 1), r"\s+", " ")
    return F.when(_col(c).rlike(rf"{head}\s++\S"), F.concat(first, F.lit(ellipsis))).otherwise(first) if ellipsis else first


def question_key(c: Column | str) -> Column:
    """Full digest of the normalised question: the key for upserts."""
    return F.md5(F.lower(strip(c)))


def question_hash(c: Column | str) -> Column:
    return F.left(question_key(c), F.lit(8))


def preview(c: Column | str, n: int) -> Column:
    return F.concat(F.left(_col(c), F.lit(n)), F.lit("..."))
