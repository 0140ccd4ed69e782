"""Source-code lexing as column expressions: one regular expression cuts, a CASE normalises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved words of the two token languages.
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while"
).split()
C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed "
    "sizeof static struct switch typedef union unsigned void volatile while"
).split()
# The normalised view of parsed code keeps two words more.
T2_KEYWORDS = [*JAVA_KEYWORDS, "var", "record"]

# Operators of two characters.
TWO_CHAR = ("==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "<<", ">>", "&=", "|=", "^=", "->")

NUMBER = r"0[xX][0-9a-fA-F]*|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_OPERATOR = "|".join("".join(f"\\{c}" for c in op) for op in TWO_CHAR)


def patterns(many: str) -> tuple[str, str, str]:
    """(tokens, tokens of the normalised view, what stripping looks at), without look-around. many: how groups repeat, ``*`` or possessive ``*+``.

    What follows a group can't begin with what the group takes, so both mean the same. Java's engine calls itself for each round of ``*``
    over a group and overflows its stack on long literals and comments; the possessive form is a loop. RE2 knows only the first.
    """
    text = rf'"(?:\\[\s\S]|[^"\\]){many}\\?"?'
    character = rf"'(?:\\[\s\S]|[^'\\]){many}\\?'?"
    line, block = r"//[^\n]*", rf"/\*(?:[^*]|\*+[^*/]){many}(?:\*+/|\**$)"
    token = rf"({line}|{block}|{text}|{character}|[\p{{L}}_][\p{{L}}\p{{Nd}}_]*|{NUMBER}|{_OPERATOR}|\S)"
    token2 = rf"({line}|{block}|{text}|{character}|[\p{{L}}_$][\p{{L}}\p{{Nd}}_$]*|{NUMBER}|>>>=|>>>|<<=|>>=|{_OPERATOR}|::|\S)"
    return token, token2, rf"({text}|{character})|{line}|{block}|\s+"


TOKEN, TOKEN_T2, STRIP = patterns("*")  # for RE2
LONG_TOKEN, LONG_TOKEN_T2, LONG_STRIP = patterns("*+")


def language_of(path: Column) -> Column:
    """JAVA for ``.java``; C for all else."""
    return F.when(path.endswith(".java"), "JAVA").otherwise("C")


def raw_tokens(text: Column, pattern: str = LONG_TOKEN_T2) -> Column:
    """Tokens as written, without blanks and comments."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.filter(found, lambda t: ~t.startswith("//") & ~t.startswith("/*"))


def _normalise(tokens: Column, keywords: list[str], character: str, start: str) -> Column:
    def one(t: Column) -> Column:
        return (
            F.when(t.startswith('"'), "STR")
            .when(t.startswith("'"), character)
            .when(t.rlike(r"^(?:[0-9]|\.[0-9])"), "NUM")
            .when(t.rlike(start) & ~t.isin(*keywords), "ID")
            .otherwise(t)
        )

    return F.transform(tokens, one)


def baseline_tokens(text: Column, keywords: list[str] = JAVA_KEYWORDS) -> Column:
    """The always normalising lexer: literals become STR, CHAR and NUM, names ID."""
    return _normalise(raw_tokens(text, LONG_TOKEN), keywords, "CHAR", r"^[\p{L}_]")


def t2_tokens(text: Column) -> Column:
    """Normalised tokens of parsed code: CHR for characters, ``$`` in names."""
    return _normalise(raw_tokens(text), T2_KEYWORDS, "CHR", r"^[\p{L}_$]")


def exact_key(text: Column) -> Column:
    """The text without comments and white space; literals stay as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LONG_STRIP, "$1")


def descriptor_types(descriptor: Column) -> Column:
    """Parameter types of a JVM method descriptor, in source form: simple lower-case names."""
    inside = F.regexp_extract(descriptor, r"\(([^)]*)\)", 1)
    names = F.create_map(*[F.lit(x) for pair in zip("ZBCSIJFDV", "boolean byte char short int long float double void".split(), strict=True) for x in pair])

    def one(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^\[+", "")
        name = F.when(bare.startswith("L"), F.lower(F.regexp_extract(bare, r"([^/$;]+);$", 1))).otherwise(names[bare])
        return F.concat(name, F.repeat(F.lit("[]"), F.length(t) - F.length(bare)))

    return F.transform(F.regexp_extract_all(inside, F.lit(r"(\[*(?:L[^;]+;|[A-Z]))"), F.lit(1)), one)


def erased_signature(signature: Column) -> Column:
    """name(type,type) in lower case: no generics, however deep, qualifiers or parameter names; varargs are arrays. An open ``<`` reaches to the end."""
    deeper = lambda x, c: F.when(c == "<", x["depth"] + 1).when((c == ">") & (x["depth"] > 0), x["depth"] - 1).otherwise(x["depth"])
    shown = lambda x, c: F.when((x["depth"] > 0) | (c == "<"), F.lit("")).otherwise(c)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    s = F.aggregate(F.split(signature, ""), start, lambda x, c: F.struct(deeper(x, c).alias("depth"), F.concat(x["out"], shown(x, c)).alias("out")), lambda x: x["out"])
    s = F.regexp_replace(F.regexp_replace(s, r"\.\.\.", "[]"), r"\b(?:final)\s+|@\w+\s*", "")
    s = F.regexp_replace(s, r"(?:\w+\.)+(\w+)", "$1")
    s = F.regexp_replace(s, r"\s+(\w+)\s*([,)])", "$2")
    return F.lower(F.regexp_replace(s, r"\s+", ""))
