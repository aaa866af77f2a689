"""Compiler diagnostics, patches and request payloads, as JSON columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIAGNOSTIC = "reason string, message struct<message:string,level:string,spans:array<struct<is_primary:boolean,file_name:string,line_start:int,column_start:int>>>"


def diagnostics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(message, level, file_name, line_start, column_start) of JSON lines whose reason is
    compiler-message; the primary span, else the first. Lines that are no JSON are left out."""
    d = F.from_json(F.col(column), DIAGNOSTIC)
    rows = lines.select(*[c for c in lines.columns if c != column], d.alias("d")).where("d.reason = 'compiler-message'")
    spans = F.col("d.message.spans")
    span = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), 0), F.get(spans, 0))
    keep = [c for c in lines.columns if c != column]
    return rows.select(*keep, F.col("d.message.message").alias("message"), F.col("d.message.level").alias("level"), span.alias("s")).select(
        *keep, "message", "level", "s.file_name", "s.line_start", "s.column_start"
    )


def verity(rows: DataFrame, key: str) -> DataFrame:
    """(key, score): 1 without diagnostics, 0 with any error, else max(0.1, 1 - 0.1 * warnings). A
    null level is no diagnostic."""
    errors = F.sum((F.col("level") == "error").cast("int"))
    count = F.count("level")
    score = F.when(count == 0, 1.0).when(errors > 0, 0.0).otherwise(F.greatest(F.lit(0.1), 1 - 0.1 * count))
    return rows.groupBy(key).agg(F.round(score, 6).alias("score"))


def render_errors(rows: DataFrame, key: str, order: str, limit: int = 5) -> DataFrame:
    """(key, prompt): what a model is told of each failed target: which patch failed and at which attempt
    of how many, the first `limit` errors (at least one) in their order with their place, how many
    follow, and what to do. rows has key, path, attempt, attempts, order and the columns of
    `diagnostics`; only errors are shown, and targets without errors have no row."""
    item = F.struct(order, "file_name", "line_start", "column_start", "message")
    packed = rows.where("level = 'error'").groupBy(key, "path", "attempt", "attempts").agg(F.array_sort(F.collect_list(item)).alias("es"))
    shown = max(limit, 1)
    place = lambda e: F.coalesce(F.format_string("error at %s:%d:%d\n", e["file_name"], e["line_start"], e["column_start"]), F.lit("error\n"))
    line = F.transform(F.slice("es", 1, shown), lambda e: F.concat(F.when(e["file_name"].isNull(), F.lit("error\n")).otherwise(place(e)), F.lit("  "), e["message"], F.lit("\n")))
    more = F.when(F.size("es") > shown, F.format_string("\n... and %d further errors, which probably follow from those above.\n", F.size("es") - shown)).otherwise("")
    head = F.format_string("Your patch to %s did not compile (attempt %d of %d).\n\n", "path", "attempt", "attempts")
    tail = F.lit("\nMend the cause of the first error and give the whole corrected file. Do not remove the failing code.")
    return packed.select(key, F.concat(head, F.array_join(line, ""), more, tail).alias("prompt"))


# Snippets that are dangerous to see in a language, and the name and kind of the finding.
DANGERS = (
    (("rust", "rs"), ("unsafe",), "UnsafeBlock"),
    (("typescript", "ts", "tsx"), ("eval(", "dangerouslySetInnerHTML"), "DangerousSuture"),
    (("python", "py"), ("exec(", "pickle.load"), "PythonExecGate"),
)
DANGER_KIND = "unsafe_gate"


def dangers(language: Column, text: Column) -> Column:
    """Array of struct(name, kind, language): what a text of the language has that is dangerous; empty for
    other languages."""
    kind = "array<struct<name:string,kind:string,language:string>>"
    out = F.from_json(F.lit("[]"), kind)
    for names, snippets, found in DANGERS:
        hit = F.lit(False)
        for x in snippets:
            hit = hit | text.contains(x)
        one = F.array(F.struct(F.lit(found).alias("name"), F.lit(DANGER_KIND).alias("kind"), F.lit(names[0]).alias("language")))
        out = F.when(language.isin(*names) & hit, one).otherwise(out)
    return out


def first_object(text: str | None) -> str | None:
    """First balanced {...} of a text, braces inside string literals not counted."""
    if text is None:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def extract_object(text: Column) -> Column:
    """first_object as a column function."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return run(text)


def safe_path(path: Column) -> Column:
    """Whether a patch path stays inside the tree: not null or blank, not absolute or rooted, no
    drive, and '..' never climbs above the start."""
    p = F.translate(path, "\\", "/")
    parts = F.filter(F.split(p, "/"), lambda c: (c != "") & (c != "."))
    low = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, c: F.struct((s["d"] + F.when(c == "..", -1).otherwise(1)).alias("d"), F.least(s["low"], s["d"] + F.when(c == "..", -1).otherwise(1)).alias("low")),
    )
    return F.coalesce((F.trim(path) != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (low["low"] >= 0), F.lit(False))


# Key spellings of a patch's path and content, in the order in which they are tried.
PATH_KEYS = ("path", "file", "file_path", "relative_path")
CONTENT_KEYS = ("content", "code", "contents", "new_content")


def parsed_patch(reply: Column) -> Column:
    """struct(path, content, safe) of a JSON reply with any of the key spellings; null fields without."""
    v = F.try_parse_json(reply)
    first = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])
    path = first(*PATH_KEYS)
    return F.struct(path.alias("path"), first(*CONTENT_KEYS).alias("content"), safe_path(path).alias("safe"))


def asked_text(payload: Column) -> Column:
    """What a request payload asks: `prompt`, else the last user message, whose content is a string or
    text blocks joined by line feeds; null without either."""
    v = F.try_parse_json(payload)
    messages = F.from_json(payload, "messages array<struct<role:string,content:string>>")["messages"]
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]
    blocks = F.from_json(last, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.coalesce(F.try_variant_get(v, "$.prompt", "string"), F.when(last.startswith("[") & F.exists(blocks, lambda b: b["type"] == "text"), joined).otherwise(last))


def message_text(reply: Column) -> Column:
    """Text of a chat reply: the first choice's content where it is not blank, else the arguments of its
    first tool call; null without either."""
    v = F.try_parse_json(reply)
    content = F.try_variant_get(v, "$.choices[0].message.content", "string")
    arguments = F.try_variant_get(v, "$.choices[0].message.tool_calls[0].function.arguments", "string")
    return F.coalesce(F.when(F.regexp_replace(content, r"\s+", "") != "", content), arguments)


def injected_payload(payload: str | None, context: str | None, dialect: str | None) -> str | None:
    """Request JSON with the context put first. In the 'anthropic' dialect it goes to the top-level
    system prompt: a string becomes one text block after the context and an empty line, an array
    gets a block in front, anything else becomes an array of that block; in all others it is a
    leading system message, or stands before the prompt with an empty line between. Anything
    else, no JSON object or no context comes back unchanged."""
    if payload is None or not context:
        return payload
    try:
        body = json.loads(payload)
    except ValueError:
        return payload
    if not isinstance(body, dict):
        return payload
    if dialect == "anthropic":
        block = {"type": "text", "text": context, "cache_control": {"type": "ephemeral"}}
        system = body.get("system")
        if isinstance(system, str):
            body["system"] = [{"type": "text", "text": f"{context}\n\n{system}"}]
        elif isinstance(system, list):
            system.insert(0, block)
        else:
            body["system"] = [block]
    elif isinstance(body.get("messages"), list):
        body["messages"].insert(0, {"role": "system", "content": context})
    elif isinstance(body.get("prompt"), str):
        body["prompt"] = f"{context}\n\n{body['prompt']}"
    return json.dumps(body)


def inject(payload: Column, context: Column, dialect: Column) -> Column:
    """injected_payload as a column function."""

    @F.pandas_udf(T.StringType())
    def run(payloads: pd.Series, contexts: pd.Series, dialects: pd.Series) -> pd.Series:
        return pd.Series([injected_payload(p, c, d) for p, c, d in zip(payloads, contexts, dialects, strict=True)])

    return run(payload, context, dialect)
