"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files worth indexing.
EXTENSIONS = (
    "asm c cc cpp cs cu go h hip hpp java js json jsx kt lua m md metal mm php proto ps1 py rb rs s sh sql swift toml ts tsx yaml yml"
).split()
# Directories that are never indexed.
IGNORED_DIRS = (
    ".aim .cache .git .idea .next .venv .vscode-test Pods __pycache__ build dist node_modules out target vendor venv"
).split()
# Keywords before a declared symbol.
DECLARATIONS = "class const def enum fn function impl interface let macro mod static struct trait type var".split()
# Words that carry no query content.
STOPWORDS = (
    "a about again all also am an and any are as at bad be been being but by can cool could did do does else for from good great "
    "had has have he hello here hey hi hmm how i if in into is it its just let lets may me might more most must my nice no nope "
    "not now of ok okay on only oops or our out over please shall she should so some sorry sounds still sure than thank thanks "
    "that the their then there these they this those thx to too under up very was we were what when where which who why will "
    "with would wow yeah yep yes you your"
).split()

#: A run of letters or digits.
ALNUM = r"[\p{L}\p{N}]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_estimate(text: Column | str) -> Column:
    """max(1, ceil(UTF-8 bytes / 3.2)); null for null text."""
    c = _column(text)
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.ceil(F.octet_length(c) / F.lit(3.2)))).cast("int")


def normal_path(path: Column | str) -> Column:
    """Path with forward slashes only."""
    return F.translate(_column(path), "\\", "/")


def extension(path: Column | str) -> Column:
    """Last extension in ASCII lower case, empty if there is none."""
    return F.lower(F.regexp_extract(normal_path(path), r"\.([^./]+)$", 1))


def is_indexable(path: Column | str) -> Column:
    """Known extension and no ignored or dotted directory; a dotted file name is allowed."""
    dirs = F.split(F.regexp_replace(normal_path(path), r"[^/]*$", ""), "/")
    bad = F.exists(dirs, lambda d: d.isin(IGNORED_DIRS) | (d.startswith(".") & ~d.isin(".", "..")))
    return extension(path).isin(EXTENSIONS) & ~bad


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters or digits; the underscore parts words, camel case does not."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(ALNUM), F.lit(0))


def subwords(text: Column | str) -> Column:
    """Lower-cased parts of identifiers: cut at non-alphanumerics, camel humps, the end of an
    acronym, and between letters and digits."""
    c = _column(text)
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"([\p{Ll}])(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        c = F.regexp_replace(c, pattern, "$1 $2")
    return F.regexp_extract_all(F.lower(c), F.lit(ALNUM), F.lit(0))


def looks_like_code(token: Column | str) -> Column:
    """A slash or underscore inside, or a name with a known extension."""
    c = _column(token)
    stem = F.regexp_extract(c, r"^(.+)\.[^.]+$", 1)
    return c.rlike("[/_]") | ((stem != "") & F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1)).isin(EXTENSIONS))


def defines_pattern(symbol: str) -> str:
    """Regular expression for a line of lower-cased text that declares or assigns a symbol."""
    name = symbol.lower().replace("\\", "\\\\")
    for ch in ".^$*+?()[]{}|":
        name = name.replace(ch, "\\" + ch)
    keys = "|".join(DECLARATIONS)
    return rf"(^|[^\p{{L}}\p{{N}}_])({keys})[ \t]+{name}($|[^a-z0-9_])|(^|[^a-z0-9_]){name}[ \t]*(=($|[^=])|:($|[^:]))"


def defines(text: Column | str, symbol: str) -> Column:
    """Whether any line of the text defines the symbol, without regard to case."""
    low = F.lower(_column(text))
    # Most texts do not have the symbol at all; a plain search settles them before any pattern runs.
    return low.contains(symbol.lower()) & F.exists(F.split(low, "\n"), lambda line: line.rlike(defines_pattern(symbol)))


def defined_symbols(text: Column | str) -> Column:
    """Distinct names that a text defines, in lower case, as whole runs of letters, digits and underscores:
    the inverse of `defines`, which turns a search for definitions of many symbols into an equi-join."""
    low = F.lower(_column(text))
    keys, name = "|".join(DECLARATIONS), r"[\p{L}\p{N}_]+"
    # The name is only looked at, since it may itself be the keyword before another name.
    declared = F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{keys})[ \t]+(?=({name}))"), F.lit(1))
    assigned = F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({name})[ \t]*(?:=(?!=)|:(?!:))"), F.lit(1))
    return F.array_distinct(F.concat(declared, assigned))


def path_hints(query: Column | str) -> Column:
    """Sorted, distinct path-like words of a query: cut at blanks, brackets, quotes, commas and
    semicolons, trimmed of dots and slashes, 3 to 200 bytes, with a directory or a known extension."""
    words = F.split(_column(query), r"[\s()\[\]{}<>\"'`,;]+")
    words = F.transform(words, lambda w: F.regexp_replace(normal_path(w), r"^[./]+|[./]+$", ""))
    known = lambda w: F.lower(F.regexp_extract(w, r"[^/]\.([^./]+)$", 1)).isin(EXTENSIONS)
    kept = F.filter(words, lambda w: (F.octet_length(w) >= 3) & (F.octet_length(w) <= 200) & (w.contains("/") | known(w)))
    return F.array_sort(F.array_distinct(kept))


def gate(query: Column | str, min_content: int = 3, long_word: int = 12) -> Column:
    """struct(decision, reason, content): 'retrieve' at the first word that looks like code or with
    at least min_content distinct content words, else 'skip'. Content words have two or more
    bytes, are not numbers, and are no stop words unless they have long_word bytes. A null or
    blank query is skipped as empty."""
    q = _column(query)
    words = F.split(q, r"[^\p{L}\p{N}_./]+")
    words = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[./]+|[./]+$", "")))
    words = F.filter(words, lambda w: w != "")
    code = F.exists(words, looks_like_code)
    parts = F.flatten(F.transform(words, lambda w: F.split(w, r"\.")))
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    content = F.filter(
        parts, lambda p: (F.octet_length(p) >= 2) & ~p.rlike("^[0-9]+$") & (~F.array_contains(stop, p) | (F.octet_length(p) >= long_word))
    )
    found = F.size(F.array_distinct(content))
    empty = q.isNull() | (F.trim(F.regexp_replace(q, r"\s+", " ")) == "")
    return F.struct(
        F.when(empty, "skip").when(code | (found >= min_content), "retrieve").otherwise("skip").alias("decision"),
        F.when(empty, "empty").when(code, "code").when(found >= min_content, "content").otherwise("too_few").alias("reason"),
        F.when(empty, 0).otherwise(found).alias("content"),
    )


def human_bytes(n: Column | str) -> Column:
    """Size with two decimals in B, KiB, MiB or GiB."""
    c = _column(n).cast("double")
    out = F.format_string("%.2f GiB", c / 2.0**30)
    out = F.when(c < 2.0**30, F.format_string("%.2f MiB", c / 2.0**20)).otherwise(out)
    out = F.when(c < 2.0**20, F.format_string("%.2f KiB", c / 2.0**10)).otherwise(out)
    return F.when(c < 2.0**10, F.format_string("%d B", _column(n).cast("long"))).otherwise(out)


def truncated_bytes(text: Column | str, limit: int) -> Column:
    """The longest start of a text of whole characters that takes at most `limit` bytes of UTF-8: the cut
    steps back, three bytes at most, until the next byte does not continue a character."""
    raw = F.encode(_column(text), "UTF-8")
    begins = lambda m: ~F.hex(F.substring(raw, m + 1, 1)).between("80", "BF")
    cuts = [F.when(begins(m), F.substring(raw, 1, m)) for m in range(limit, max(limit - 4, -1), -1)]
    return F.decode(F.coalesce(*cuts), "UTF-8")


def align_up(n: Column | str, to: int = 16) -> Column:
    """n rounded up to a multiple of `to`, a power of two."""
    c = _column(n).cast("long")
    return (c + F.lit(to - 1)).bitwiseAND(F.lit(~(to - 1)))


def content_hash(text: Column | str) -> Column:
    """First 32 hex digits of the SHA-256 of the text (stands for a 16-byte digest)."""
    return F.substring(F.sha2(_column(text), 256), 1, 32)


def embedder_dim(embedder_id: Column | str) -> Column:
    """Dimension at the end of an embedder id, after its last '-d'."""
    return F.regexp_extract(_column(embedder_id), r"-d([0-9]+)$", 1).try_cast("int")


def embedder_server(embedder_id: Column | str) -> Column:
    """Server tag of an embedder id 'tag:model-dN'; null for built-in hash embedders."""
    tag = F.regexp_extract(_column(embedder_id), r"^([^:]+):.+-d[0-9]+$", 1)
    return F.when(tag != "", tag)
