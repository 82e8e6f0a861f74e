"""Column expressions on text and code: cleaning, tokens, query words. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of typographic characters, in order, with their Unicode names.
UNICODE_FIXES = (
    ("’", "'", "RIGHT SINGLE QUOTATION MARK"),
    ("‘", "'", "LEFT SINGLE QUOTATION MARK"),
    ("“", '"', "LEFT DOUBLE QUOTATION MARK"),
    ("”", '"', "RIGHT DOUBLE QUOTATION MARK"),
    ("–", "-", "EN DASH"),
    ("—", "-", "EM DASH"),
    (" ", " ", "NO-BREAK SPACE"),
    ("…", "...", "HORIZONTAL ELLIPSIS"),
)
# Operators and the words that stand for them in the word index, longest first.
SYMBOL_WORDS = (
    ("=/=", "symnoteq"),
    (":=", "symassign"),
    ("=>", "symruleto"),
    ("~>", "symsquig"),
    ("->", "symarrow"),
    ("/\\", "symconj"),
    ("\\/", "symdisj"),
    ("<=", "symleq"),
    (">=", "symgeq"),
    ("==", "symeqeq"),
)
# Words too common to search by, rare keywords and symbols worth a search.
COMMON_KEYWORDS = "fmod mod fth th sort op ops var vars ctor assoc comm id protecting including extending eq subsort".split()
RARE_KEYWORDS = "ceq cmb crl rl mb owise frozen strat variant".split()
RARE_SYMBOLS = (":=", "~>", "=>", "/\\")
COMMON_CLIENT_WORDS = "client qdrant collection collections points point vector vectors import from print result name models http localhost".split()

# The patterns that say what a search token is, and what a query derived from code is made of.
PATH_TOKEN = r"/[\w/{}.-]+"
QUERY_TOKEN = r"[:\w]+=|[^\w\s]{2,}|\b\w{4,}\b"
BRACKETS = r"\[([^\]]+)\]"
CLIENT_NAMES = (r"\b([a-z]+(?:_[a-z0-9]+)+)\s*[=:]", r"\.\s*([a-z_]{4,})\s*\(")
CLIENT_CLASSES_AND_ROUTES = (r"models\.([A-Za-z]+)", r"(?U)(/collections/[\w/{}.-]*)")

SPECIAL, WORD = "special", "word"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; null for null."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def token_count(c: Column, specials: int = 2) -> Column:
    """Default token count: runs of word characters and single marks, plus ``specials``; null: null."""
    return F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]")) + specials


def query_tokens(c: Column, docs_site: bool = False) -> Column:
    """Array of (token, kind) that a query searches by, duplicates kept.

    A token with a mark in it is special and kept as it stands; a word is lower-cased.
    The docs-site flavour also takes paths, and counts an underscore as special.
    """
    pattern = (f"{PATH_TOKEN}|" if docs_site else "") + QUERY_TOKEN
    bare = F.transform(matches(c, "(?U)" + pattern), lambda t: F.regexp_replace(t, "^[\"'`]+|[\"'`]+$", ""))
    odd = r"(?U)[^\w]" + ("|_" if docs_site else "")

    def typed(t: Column) -> Column:
        special = F.rlike(t, F.lit(odd))
        return F.struct(F.when(special, t).otherwise(F.lower(t)).alias("token"), F.when(special, SPECIAL).otherwise(WORD).alias("kind"))

    return F.transform(F.filter(bare, lambda t: t != ""), typed)


def code_constructions(code: Column) -> Column:
    """Query text from a program of the rewriting language: rare attributes, keywords and symbols, sorted."""
    inside = F.flatten(F.transform(matches(code, BRACKETS, 1), lambda a: F.split(strip(a), r"(?U)\s+")))
    common = F.array(*map(F.lit, COMMON_KEYWORDS))
    rare = F.filter(inside, lambda w: F.rlike(w, F.lit(r"(?U)^\p{L}+$")) & ~F.array_contains(common, F.lower(w)))
    flagged = [F.when(F.rlike(code, F.lit(rf"(?U)\b{k}\b")), F.lit(k)) for k in RARE_KEYWORDS]
    flagged += [F.when(F.contains(code, F.lit(s)), F.lit(s)) for s in RARE_SYMBOLS]
    found = F.array_compact(F.array(*flagged))
    return F.array_join(F.sort_array(F.array_distinct(F.concat(rare, found))), " ")


def client_constructions(code: Column) -> Column:
    """Query text from client code: named parameters, method calls, model classes, routes, sorted."""
    common = F.array(*map(F.lit, COMMON_CLIENT_WORDS))
    names = F.concat(*[matches(code, p, 1) for p in CLIENT_NAMES])
    fixed = F.concat(*[matches(code, p, 1) for p in CLIENT_CLASSES_AND_ROUTES])
    return F.array_join(F.sort_array(F.array_distinct(F.concat(F.array_except(names, common), fixed))), " ")


def query_or_start(query: Column, code: Column, chars: int = 200) -> Column:
    """The derived query, or the code's first characters where nothing was derived."""
    return F.when(F.coalesce(query, F.lit("")) == "", F.substring(code, 1, chars)).otherwise(query)


def is_readable(text: Column) -> Column:
    """At least five words, of which fewer than 0.4 have one character."""
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    single = F.regexp_count(text, F.lit(r"(?U)(?<!\S)\S(?!\S)"))
    return (words >= 5) & (single / F.greatest(words, F.lit(1)) < 0.4)


def has_typeset_symbols(code: Column) -> Column:
    """Holds grammar or typeset marks, so it is no code to index."""
    return F.rlike(code, F.lit("::=|⟨|⟩|∣"))


def protect_symbols(text: Column) -> Column:
    """Operators written as words, blank-padded, longest first, so that a word index holds them."""
    words = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(f" {s[1]} ")), SYMBOL_WORDS, text)
    return F.when(F.rlike(text, F.lit(r"[=>\\]")), words).otherwise(text)  # each operator has one of these marks


def autofix(code: Column) -> Column:
    """The code with typographic characters made ASCII."""
    return reduce(lambda c, f: F.replace(c, F.lit(f[0]), F.lit(f[1])), UNICODE_FIXES, code)


def autofixes(code: Column) -> Column:
    """Names of the typographic characters that ``autofix`` replaces, in order."""
    return F.array_compact(F.array(*[F.when(F.contains(code, F.lit(bad)), F.lit(name)) for bad, _, name in UNICODE_FIXES]))


def fenced(text: Column, fence: str = "```") -> Column:
    """Struct (comment, code) of a reply: lines outside and inside of fences, which toggle at a line's start.

    The text is cut at its fence lines, so the parts lie outside and inside by turns; time grows with the length.
    """
    parts = F.split(F.concat(F.lit("\n"), text), rf"\n\Q{fence}\E[^\n]*", -1)  # of lines with the break before them
    turn = lambda n: F.substr(F.array_join(F.filter(parts, lambda _, i: i % 2 == n), ""), F.lit(2))
    return F.struct(turn(0).alias("comment"), turn(1).alias("code"))


def fenced_or_whole(text: Column) -> Column:
    """As ``fenced``, stripped; a reply without code is taken whole as code."""
    parts = fenced(text)
    none = strip(parts["code"]) == ""
    return F.struct(
        F.when(none, F.lit("")).otherwise(strip(parts["comment"])).alias("comment"),
        F.concat(F.when(none, strip(text)).otherwise(strip(parts["code"])), F.lit("\n")).alias("code"),
    )


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by file suffix; null if unknown."""
    s = suffix_of(path)
    return F.when(s.isin(".cc", ".cpp", ".cxx"), "C++").when(s == ".py", "Python").when(s == ".rs", "Rust").when(s == ".maude", "Maude").when(s == ".dfy", "Dafny")


def line_comment(path: Column) -> Column:
    """Mark that starts a comment line, by file suffix."""
    s = suffix_of(path)
    return F.when(s == ".maude", "***\t").when(s == ".py", "#\t").otherwise("//\t")


def with_provenance(path: Column, model: Column, comment: Column, code: Column) -> Column:
    """Code under a header of comment lines that names the model it is from."""
    mark = line_comment(path)
    bare = F.rtrim(F.regexp_replace(mark, r"\s+$", ""))
    lines = F.transform(F.split(comment, "\n", -1), lambda x: F.regexp_replace(F.concat(mark, x), r"(?U)\s+$", ""))
    return F.concat(bare, F.lit("\n"), mark, F.lit('<comment from="'), model, F.lit('">\n'), F.array_join(lines, "\n"), F.lit("\n"), mark, F.lit("</comment>\n"), bare, F.lit("\n\n"), code)


def provenance(code: Column) -> Column:
    """Model that a header names; empty without one."""
    return F.regexp_extract(code, '<comment from="([^"]*)"', 1)


def without_header(code: Column) -> Column:
    """Code without lines that start with the comment mark ``***``."""
    return F.regexp_replace(code, r"(?m)^\*\*\*.*\n?", "")


def preview(text: Column, chars: int = 120) -> Column:
    """First characters on one line."""
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))
