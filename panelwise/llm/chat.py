"""Chat formatting with layouts chosen by schema fingerprint, in DataFrame operations only.

A record is a JSON string. The paths of its fields, nested ones included, are hashed; the hash
selects a declarative mapping (``LAYOUTS``) that says where the turns are. Records become canonical
turns (role, text), turns become one string under a template, with a loss mask as spans of code points.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts a backslash becomes two, and a
backslash is put inside whatever looks like a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so
no control string is left and taking a backslash away before each character restores the text. Roles are
percent-encoded. The mask covers the assistants' texts.

Defined results: a NULL text is empty, a NULL role is the empty role; turns are ordered by turn (NULL
first), ties by role and text, repeated rows are repeated turns; a record whose fingerprint is not listed (or
that is no JSON object) has no turns and ``layout`` NULL; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"

#: The layouts. Either (role, path) pairs, or the path of a list with the names of its role and text fields.
LAYOUTS: dict[str, dict] = {
    "prompt": {"fields": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "dialogue": {"list": "dialogue", "role": "from", "text": "value"},
    "nested": {"list": "data.turns", "role": "speaker", "text": "utterance"},
}


def layout_paths(layout: dict) -> list[str]:
    """All field paths of records of a layout, sorted; list elements are marked []."""
    if "fields" in layout:
        return sorted(p for _, p in layout["fields"])
    parts = layout["list"].split(".")
    outer = [".".join(parts[: i + 1]) for i in range(len(parts))]
    return sorted([*outer, *(f"{layout['list']}[].{layout[k]}" for k in ("role", "text"))])


def field_paths(record: Column, depth: int = 2) -> Column:
    """The sorted paths of a JSON object's fields: of objects down to ``depth``, and of lists' elements."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    plain = keys
    values = F.from_json(record, "map<string,string>")

    def below(key: Column) -> Column:
        value = values[key]
        elements = F.from_json(value, "array<map<string,string>>")
        listed = F.array_distinct(F.flatten(F.transform(elements, lambda e: F.map_keys(e))))
        listed = F.transform(listed, lambda k: F.concat(key, F.lit("[]."), k))
        inner = field_paths(value, depth - 1) if depth > 1 else F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
        inner = F.transform(inner, lambda k: F.concat(key, F.lit("."), k))
        none = F.array().cast("array<string>")
        return F.when(value.startswith("["), F.coalesce(listed, none)).when(value.startswith("{"), inner).otherwise(none)

    return F.array_sort(F.array_distinct(F.concat(plain, F.flatten(F.transform(keys, below)))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", paths))


def listed_turns(listed: Column, rule: dict) -> Column:
    return F.transform(listed, lambda t: F.struct(
        F.coalesce(t[rule["role"]], F.lit("")).alias("role"), F.coalesce(t[rule["text"]], F.lit("")).alias("text")))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout`` and ``turns``."""
    out = records.withColumn("_print", fingerprint(field_paths(F.col(record))))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, rule in LAYOUTS.items():
        hit = F.col("_print") == fingerprint(F.array(*map(F.lit, layout_paths(rule))))
        if "fields" in rule:
            kind = ", ".join(f"`{p}` string" for _, p in rule["fields"])
            parsed = F.from_json(F.col(record), kind)
            made = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(parsed[p], F.lit("")).alias("text")) for r, p in rule["fields"]])
        else:
            kind = f"array<struct<`{rule['role']}`:string,`{rule['text']}`:string>>"
            path = rule["list"].split(".")
            for step in reversed(path):
                kind = f"struct<`{step}`:{kind}>"
            parsed = F.from_json(F.col(record), kind)
            for step in path:
                parsed = parsed[step]
            made = listed_turns(parsed, rule)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, made).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("_print")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted`` and ``loss`` (spans of the assistants' texts in it, code points, end exclusive)."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn")))
    rows = turns.withColumn("_parts", parts)
    tail = len(END) + 1

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + tail).alias("at"), F.when(t["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))
    text = F.array_join(F.transform("_parts", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return rows.withColumn("formatted", text).withColumn("loss", F.aggregate("_parts", begin, step)["spans"]).drop("_parts")


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""
    whole = F.split(text, r"<\|im_start\|>", -1)
    whole = F.slice(whole, F.lit(2), F.size(whole) - 1)

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        body = F.substring(part, cut + 1, F.length(part) - cut - F.lit(len(END) + 1))
        return F.struct(F.url_decode(F.substring(part, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(whole, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    one = lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, one), "")


def records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON in the layout that suits their roles.

    ``rows`` has conv_id, turn, role, text. A prompt and its answer, an instruction with input and output, and
    three kinds of lists occur.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.concat_ws(",", F.col("t.role"))
    at = lambda i: F.col("t")[i]["text"]
    many = lambda r, c: F.transform("t", lambda x: F.struct(x["role"].alias(r), x["text"].alias(c)))
    n = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0))
    return turns.select("conv_id", (
        F.when((F.size("t") == 2) & (roles == "user,assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when((F.size("t") == 3) & (roles == "system,user,assistant"), F.to_json(F.struct(
            at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))))
        .when(n == 0, F.to_json(F.struct(many("role", "content").alias("messages"))))
        .when(n == 1, F.to_json(F.struct(many("from", "value").alias("dialogue"))))
        .otherwise(F.to_json(F.struct(F.struct(many("speaker", "utterance").alias("turns")).alias("data"))))).alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """What the output of ``formatted`` holds, read back from it."""
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"),
                        under_mask(F.col("formatted"), F.col("loss")).alias("learnt"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
