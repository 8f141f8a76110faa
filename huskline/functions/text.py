"""Column functions on lines: trimming, lexing, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python keywords (fixed values).
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield"
).split()
#: The default vocabulary of marks and keywords, in rank order (fixed values).
KEYWORD_VOCABULARY = (
    ". , ( ) = : ' \" [ ] ` > * + % \\ < ! _ ~ # ; @ ? & ^ $ { } | += -= *= /= |= == != >= <= ** -> >> << // ... "
    "if in return is for None def not and or else with True as False from raise elif class except try assert import continue pass "
    "lambda while yield break del global finally nonlocal await async"
).split()
#: Characters by id (fixed values).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz1234567890~!@#$%^&*()` ,./<>?;':\"[]{}=-+_\t\r\n|\\"
ALPHABET_200 = "abcdefghijklmnopqrstuvwxyz0123456789 -,;.!?:'\"/\\|_@#$%ˆ&*˜‘+-=()[]{}<>"
#: Operators, longest first (fixed values).
OPERATORS = "**= //= >>= <<= ... != -> := == <= >= ** // << >> -= += *= /= %= @= &= |= ^= - + * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()

#: Tokens of a line.  No look-around and no back-references, so that other engines agree; strings are unrolled, which keeps the stack flat.
LEXER = "|".join([
    r"#[^\n]*",
    r'[rRbBuUfF]{0,2}""".*?"""', r"[rRbBuUfF]{0,2}\x27\x27\x27.*?\x27\x27\x27",
    r'[rRbBuUfF]{0,2}"""[\s\S]*', r"[rRbBuUfF]{0,2}\x27\x27\x27[\s\S]*",
    r'[rRbBuUfF]{0,2}"[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"[rRbBuUfF]{0,2}\x27[^\x27\\\n]*(?:\\.[^\x27\\\n]*)*\x27",
    r"0[xXoObB][0-9a-fA-F_]+", r"(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[jJ]?",
    r"[A-Za-z_][A-Za-z0-9_]*",
    r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=]",
    r"\S",
])
IS_NAME = r"^[A-Za-z_][A-Za-z0-9_]*\z"
IS_NUMBER = r"^\.?[0-9]"
OPENS_TRIPLE = r'^[rRbBuUfF]{0,2}("""|\x27\x27\x27)'
IS_TRIPLE = r'^[rRbBuUfF]{0,2}("""[\s\S]*"""|\x27\x27\x27[\s\S]*\x27\x27\x27)\z'
IS_STRING = r'^[rRbBuUfF]{0,2}("[\s\S]*"|\x27[\s\S]*\x27)\z'


def strip_left(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def strip_right(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


#: What Python's strip() takes from ASCII text.
BLANKS = " \t\n\r\x0b\x0c"


def preclean(line: Column) -> Column:
    """Outer marks and quotes off, triple quotes as single ones."""
    out = strip_right(strip_left(line, " #'\""), " '\"")
    return F.replace(F.replace(out, F.lit('"""'), F.lit('"')), F.lit("'''"), F.lit("'"))


def kind_of(token: Column) -> Column:
    """NAME, NUMBER, STRING, OP, COMMENT or ERROR; null for a triple quote that is not closed."""
    # No operator fits one of the patterns, so those are asked of other tokens only.
    return (
        F.when(token.startswith("#"), "COMMENT").when(token.isin(OPERATORS), "OP").when(token.rlike(IS_NAME), "NAME").when(token.rlike(IS_NUMBER), "NUMBER").when(token.rlike(OPENS_TRIPLE) & ~token.rlike(IS_TRIPLE), None)
        .when((F.length(token) > 1) & token.rlike(IS_STRING), "STRING").otherwise("ERROR")
    )


def lex(line: Column) -> Column:
    """array<struct<kind, tok>> of a line, in order; an unclosed triple quote is dropped."""
    tokens = F.transform(F.regexp_extract_all(line, F.lit(LEXER), F.lit(0)), lambda t: F.struct(kind_of(t).alias("kind"), t.alias("tok")))
    return F.filter(tokens, lambda t: t["kind"].isNotNull())


def split_identifier(name: Column) -> Column:
    """Parts of a name: cut at `_`, between lower and upper case, and between letters and digits."""
    out = F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, r"([A-Za-z])([0-9])", "$1_$2")
    out = F.regexp_replace(out, r"([0-9])([A-Za-z])", "$1_$2")
    return F.filter(F.split(out, "_"), lambda p: F.length(p) > 0)


def split_names(tokens: Column) -> Column:
    """The token array with each name in place of its parts."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t["kind"] == "NAME", F.transform(split_identifier(t["tok"]), lambda p: F.struct(t["kind"].alias("kind"), p.alias("tok")))).otherwise(F.array(t))))


#: Reserved ids of the three layouts: first id of the vocabulary, and id of each class of tokens.
LAYOUTS = {
    "plain": {"first": 8, "NAME": 2, "OP": 3, "NUMBER": 4, "STRING": 5, "ERROR": 6, "COMMENT": 7},
    "short": {"first": 7, "NAME": 1, "OP": 2, "NUMBER": 3, "STRING": 4, "ERROR": 5, "COMMENT": 6},
    "context": {"first": 10, "NAME": 4, "OP": 5, "NUMBER": 6, "STRING": 7, "ERROR": 8, "COMMENT": 9},
}
PAD, CLS, SEP = 0, 1, 2


def token_ids(tokens: Column, vocabulary: list[str], layout: str = "plain") -> Column:
    """Ids of a token array.  For vocabularies of some hundred tokens; operators.vocab.ids_by_join takes larger ones."""
    ids = LAYOUTS[layout]
    listed = F.array(*map(F.lit, vocabulary))

    def one(t: Column) -> Column:
        out = F.lit(ids["ERROR"])
        for kind in ("NAME", "OP", "NUMBER", "STRING", "COMMENT"):
            out = F.when(t["kind"] == kind, ids[kind]).otherwise(out)
        known = F.when(t["kind"].isin("NAME", "OP"), F.nullif(F.array_position(listed, t["tok"]), F.lit(0)))
        return F.coalesce(known + (ids["first"] - 1), out).cast("int")

    return F.transform(tokens, one)


def bind(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once however often it is named."""
    return F.transform(F.array(value), use)[0]


def char_ids(line: Column, alphabet: str = ALPHABET, first: int = 2, unknown: int = 1) -> Column:
    """Id of each character: its place in the alphabet, counted from `first`."""
    letters = F.filter(F.split(line, ""), lambda c: F.length(c) > 0)
    return F.transform(letters, lambda c: (F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1 + first).otherwise(unknown)).cast("int"))


def pad(ids: Column, width: int, padding: str = "post", truncating: str = "pre") -> Column:
    """Exactly `width` ids: zeros at the end (or start), and the last (or first) ids of a longer array."""

    def fixed(x: Column) -> Column:
        kept = F.slice(x, F.greatest(F.size(x) - width + 1, F.lit(1)), width) if truncating == "pre" else F.slice(x, 1, width)
        zeros = F.array_repeat(F.lit(PAD), F.greatest(F.lit(width) - F.size(x), F.lit(0)))
        return F.concat(kept, zeros) if padding == "post" else F.concat(zeros, kept)

    return bind(ids, fixed)


def adjacent_names(tokens: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Do two names that are no keywords stand side by side?  Then the line reads like prose."""
    names = F.transform(tokens, lambda t: (t["kind"] == "NAME") & ~t["tok"].isin(*keywords))
    # Bound, and beside itself moved by one: an array that a lambda names from outside would be made again for each token.
    both = bind(names, lambda n: F.exists(F.zip_with(n, F.slice(n, 2, F.size(n)), lambda a, b: F.coalesce(a & b, F.lit(False))), lambda x: x))
    return F.coalesce(both, F.lit(False))


def joined(array: Column) -> Column:
    """An array as text."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")
