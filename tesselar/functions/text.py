"""Text functions as Column expressions: folding, tokens, sentences, snippets. All of them stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    sorted(
        "with will was were who when where what which you your to this they these there then them their the that she our ours or "
        "on of it its is into in if i his him her he have has from for by but been be at as are and an a".split()
    )
)
_RUN = "[a-z0-9]+"
TOKEN = f"{_RUN}(?:[._-]{_RUN})*"
_AFTER_STOP, _BEFORE_START = r"(?<=[.!?])", r"(?=[A-Z(\[`])"
SENTENCE_END = rf"{_AFTER_STOP}\s+{_BEFORE_START}|\n{{2,}}"
#: Marks of code and markup, which prose doesn't have.
CODE_MARKS = ("});", "|---", "]:", "::", "==", "();", "/>", "</", "=>", "}", "{", "className", "function ", "import ", "let ", "const ")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Code points that fold to one (source, target), those that vanish (at the end of source), and those that fold to several.

    Only what can be part of a token matters: marks vanish, and whatever decomposes into ASCII letters, digits or
    joiners is folded. Hangul and the like, which decompose into signs outside tokens, stay composed.
    """
    one, gone, many = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and re.search(r"[A-Za-z0-9._ -]", plain):
            (one if len(plain) == 1 else many).append((c, plain))
    return "".join(c for c, _ in one) + "".join(gone), "".join(p for _, p in one), many


def _in_class(chars: list[str]) -> str:
    """A regular expression for one of the characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def fold(text: Column) -> Column:
    """Lower case without accents: compatibility decomposition, combining marks dropped."""
    source, target, many = _fold_tables()
    # One literal: each entry is a code point and what it becomes.
    pairs = F.split(F.lit("\x01".join(a + b for a, b in many)), "\x01")
    spelled = F.when(text.rlike(_in_class([a for a, _ in many])), F.aggregate(pairs, text, lambda t, p: F.replace(t, F.substring(p, 1, 1), F.substring(p, F.lit(2), F.length(p))))).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.lower(F.translate(spelled, source, target))).otherwise(F.lower(text))


def tokens(text: Column, *, drop_stopwords: bool = False) -> Column:
    """Tokens of a text: runs of ASCII letters and digits joined by . _ or -, each joined one followed by its parts.

    Parts of one character are left out; stop words are dropped from tokens and parts alike if asked for.
    """
    words = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    parts = lambda t: F.filter(F.split(t, "[._-]"), lambda p: F.length(p) > 1)
    every = F.flatten(F.transform(words, lambda t: F.when(t.rlike("[._-]"), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))
    return F.filter(every, lambda t: ~t.isin(*STOPWORDS)) if drop_stopwords else every


def content_words(text: Column) -> Column:
    """Tokens of more than two characters that aren't stop words, repeats included."""
    return F.filter(tokens(text, drop_stopwords=True), lambda t: F.length(t) > 2)


def squeezed(text: Column) -> Column:
    """The text with each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column, *, min_words: int = 8) -> Column:
    """The sentences of at least min_words words, squeezed."""
    cut = F.transform(F.split(text, SENTENCE_END), squeezed)
    return F.filter(cut, lambda s: (F.length(s) > 0) & (F.size(F.split(s, " ")) >= min_words))


def indexable(title: Column, text: Column) -> Column:
    """What is indexed of a document: its title, a line feed, its text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def looks_like_prose(s: Column) -> Column:
    """Whether a sentence has no mark of code, at least 86 % letters and blanks, and at least 70 % plain words."""
    code = F.lit(False)
    for mark in CODE_MARKS:
        code = code | s.contains(mark)
    words = F.split(squeezed(s), " ")
    plain = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")))
    letters = F.regexp_count(s, F.lit(r"(?U)[\p{L}\s]"))
    return (F.length(s) > 0) & ~code & (letters >= 0.86 * F.length(s)) & (plain >= 0.7 * F.size(words))


def clean_query(s: Column) -> Column:
    """A sentence without Markdown decoration."""
    bare = F.regexp_replace(squeezed(s), r"^[-*>#| ]+", "")
    return squeezed(F.regexp_replace(bare, r"`|\*|\[\[|\]\]", ""))


def snippet(text: Column, query_words: Column, *, width: int = 260, step: int = 40) -> Column:
    """The first window of `width` characters, out of one every `step`, that has the most of query_words in it.

    Words count as often as they repeat in the query. Cut ends are marked by an ellipsis.
    """
    def bound(column: Column, use) -> Column:
        """use(column) with column evaluated once, although lambdas inside refer to it again and again."""
        return F.get(F.transform(F.array(column), use), 0)

    def cut(body: Column) -> Column:
        n = F.length(body)
        begins = F.sequence(F.lit(0), F.greatest(n - width, F.lit(1)) - 1, F.lit(step))

        def best(low: Column, words: Column) -> Column:
            def hits(at: Column) -> Column:
                return bound(F.substring(low, at + 1, F.lit(width)), lambda window: F.struct(F.size(F.filter(words, lambda w: F.contains(window, w))).alias("hits"), (-at).alias("minus")))

            return F.array_max(F.transform(begins, hits))

        def shown(top: Column) -> Column:
            at = F.when(top["hits"] > 0, -top["minus"]).otherwise(F.lit(0))
            return F.concat(F.when(at > 0, "…").otherwise(""), F.substring(body, at + 1, F.lit(width)), F.when(at + width < n, "…").otherwise(""))

        return bound(fold(body), lambda low: bound(query_words, lambda words: bound(best(low, words), shown)))

    return bound(squeezed(F.coalesce(text, F.lit(""))), cut)
