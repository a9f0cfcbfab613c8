"""Text normalisation as Spark columns: decoding, white space, comments, XML noise, tokens.

A shadow has as many lines as the text it comes from: what is blanked leaves its line feeds. Patterns are Java's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their rule sets.
RULESETS = {
    ".c": "c", ".h": "c", ".arxml": "arxml", ".xml": "arxml", ".a2l": "a2l", ".py": "python", ".pyw": "python", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp",
}
SKIPPED_DIRS = (".git", "__pycache__", ".svn")
#: How many bytes are searched for a NUL: part of what a binary file is held to be, not a limit on work.
BINARY_SNIFF = 8192

# What Python's str.isspace() holds to be white space, without the line feed.
SPACE = r"[\t\x0B\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What Python's \w holds.
WORD = r"[\p{L}\p{N}_]"

_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+(?:"|(?=\n)|\\?\z)'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+(?:'|(?=\n)|\\?\z)"
_C_COMMENT = r"(//[^\n]*+|/\*.*?(?:\*/|\z))"
#: Tokens by rule set; group 1 is a comment.
COMMENT_TOKENS = {
    "c": rf"(?s){_DOUBLE}|{_SINGLE}|{_C_COMMENT}|[^\"'/]++|/",
    "cpp": rf"(?s){_DOUBLE}|{_SINGLE}|{_C_COMMENT}|[^\"'/]++|/",
    "a2l": rf'(?s)"(?:""|[^"\n])*+(?:"|(?=\n)|\z)|{_C_COMMENT}|[^"/]++|/',
    "python": rf"(?s)'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\\?\z|'{{1,2}}\z)|\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+(?:\"\"\"|\\?\z|\"{{1,2}}\z)|{_DOUBLE}|{_SINGLE}|(#[^\n]*+)|[^\"'#]++",
    "yaml": r"""(?s)"[^"\n]*+(?:"|(?=\n)|\z)|'[^'\n]*+(?:'|(?=\n)|\z)|((?<![^ \t\n])#[^\n]*+)|[^"'#]++|#""",
}
# XML that is noise, in the order in which it is blanked.
XML_NOISE = {
    "comment": r"<!--.*?-->",
    "admin-data": r"<ADMIN-DATA(?:\s[^>]*)?>.*?</ADMIN-DATA>|<ADMIN-DATA\s*/>",
    "date": r"<DATE(?:\s[^>]*)?>[^<]*</DATE>",
    "uuid": r'\bUUID\s*=\s*"[^"]*"',
    "sw-version": r"<SW-VERSION(?:\s[^>]*)?>[^<]*</SW-VERSION>",
    "description": "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>|<{t}\s*/>" for t in ("DESC", "LONG-NAME", "INTRODUCTION")),
}
# Words and tokens of C.
KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch "
    "typedef union unsigned void volatile while _Bool _Complex _Imaginary bool true false NULL"
).split()
IDENT = rf"[A-Za-z_]{WORD}*"
TOKEN = rf"""{IDENT}|0[xX][0-9a-fA-F]+[uUlL]*|\p{{Nd}}+\.?\p{{Nd}}*(?:[eE][+-]?\p{{Nd}}+)?[uUlLfF]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\S"""


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f mentions it; nested rules would multiply it otherwise."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def decode(content: Column) -> Column:
    """Bytes to text: UTF-8 with or without its mark, else Latin-1; line ends become line feeds."""
    text = F.when(F.is_valid_utf8(content), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def looks_binary(content: Column) -> Column:
    return F.contains(F.substr(content, F.lit(1), F.lit(BINARY_SNIFF)), F.lit(b"\x00"))


def ruleset(rel: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RULESETS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(rel, r"(\.[^.]*)$", 1))), F.lit("plain"))


def glob_to_regex(glob: str) -> str:
    """A file glob as a Java pattern; * crosses slashes."""
    import fnmatch

    return fnmatch.translate(glob).replace(r"\Z", r"\z").replace(r"(?>", "(?>")


def selected(rel: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Included (all, if nothing is asked for) and not excluded, by whole path or by name."""
    name = F.regexp_extract(rel, r"([^/]*)$", 1)

    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | rel.rlike(f"^{glob_to_regex(g)}") | name.rlike(f"^{glob_to_regex(g)}")
        return out

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def collapse_ws(text: Column) -> Column:
    """Runs of white space within a line become one space; lines are trimmed."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), r"(?<![^\n]) | (?![^\n])", "")


def _blanked(tokens: Column, marked: Column) -> Column:
    return F.array_join(F.zip_with(tokens, marked, lambda t, c: F.when(c != "", F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


def _without(text: Column, tokens: str) -> Column:
    """Group 1 of the tokens blanked."""
    p = F.lit(tokens)
    return F.when(text == "", text).otherwise(_blanked(F.regexp_extract_all(text, p, 0), F.regexp_extract_all(text, p, 1)))


def strip_comments(text: Column, rules: str) -> Column:
    """Comments blanked; strings and docstrings stay."""
    return let(text, lambda t: _without(t, COMMENT_TOKENS[rules]))


def blank_strings(text: Column, rules: str) -> Column:
    """Strings blanked, in text without comments."""
    return let(text, lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(COMMENT_TOKENS[rules]), 0), lambda k: F.when(k.rlike("^[\"']"), F.regexp_replace(k, r"[^\n]", " ")).otherwise(k)), ""))


def strip_directives(text: Column) -> Column:
    """Preprocessor lines blanked, with those that a backslash at the end carries on."""
    return let(text, lambda t: _without(t, r"(?m)(^[ \t]*+#(?:[^\n]*\\[^\S\n]*\n)*+[^\n]*+)|[^\n]*+\n|[^\n]++"))


def strip_xml(text: Column, rule: str) -> Column:
    """One kind of XML noise blanked; UUIDs become empty ones."""
    if rule == "uuid":
        return F.regexp_replace(text, XML_NOISE[rule], 'UUID=""')
    return let(text, lambda t: _without(t, rf"(?s)({XML_NOISE[rule]})|<|[^<]++"))


def xml_stripped(text: Column) -> Column:
    for rule in XML_NOISE:
        text = strip_xml(text, rule)
    return text


def xml_shadow(text: Column) -> Column:
    return collapse_ws(xml_stripped(text))


def shadow(text: Column, rules: Column) -> Column:
    """What a rule set leaves of a text."""

    def by_rules(t: Column) -> Column:
        bare = F.when(rules == "arxml", xml_stripped(t))
        for name in COMMENT_TOKENS:
            bare = bare.when(rules == name, strip_comments(t, name))
        return collapse_ws(bare.otherwise(t))

    return let(text, by_rules)


def move_shadow(text: Column, rules: Column) -> Column:
    """The simpler shadow by which moved files are scored."""
    return shadow(text, F.when(rules.isin("c", "a2l", "arxml"), rules).otherwise("plain"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def is_identifier(token: Column) -> Column:
    return token.rlike(f"^{IDENT}$") & ~token.isin(*KEYWORDS)


def identifiers(text: Column) -> Column:
    """Distinct identifiers, sorted. A token that begins like an identifier is one, as TOKEN takes these first."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    begins = lambda t: ((t >= "A") & (t < "[")) | ((t >= "_") & (t < "`")) | ((t >= "a") & (t < "{"))
    return F.sort_array(F.array_distinct(F.filter(found, lambda t: begins(t) & ~t.isin(*KEYWORDS))))


def apply_renames(text: Column, renames: Column) -> Column:
    """Whole identifiers replaced by a map's values."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){IDENT}|[^A-Za-z_]++|."), 0)
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(renames, t), t)), "")
