"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that says where turns, roles and texts lie. Records of
any known layout so become canonical turns, which one template renders with marks, reversible escapes and a loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.llm.common import table, unused

TURNS = "array<struct<role: string, text: string>>"
#: Declarative mappings by layout: the paths a record has, the list of turns with its role and text fields, or fixed (role, path) pairs.
LAYOUTS = {
    "rows": {"paths": ["turns[].order", "turns[].role", "turns[].text"], "list": "turns", "role": "role", "text": "text", "order": "order"},
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": "messages", "role": "role", "text": "content"},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    "instruction_input": {"paths": ["input", "instruction", "output"], "fixed": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction": {"paths": ["instruction", "output"], "fixed": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_system": {"paths": ["input", "instruction", "output", "system"], "fixed": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "prompt": {"paths": ["completion", "prompt"], "fixed": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fixed": [("user", ["prompt"]), ("assistant", ["response"])]},
    "question": {"paths": ["answer", "question"], "fixed": [("user", ["question"]), ("assistant", ["answer"])]},
    "nested_prompt": {"paths": ["prompt.text", "response.text"], "fixed": [("user", ["prompt.text"]), ("assistant", ["response.text"])]},
}


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode(errors="surrogatepass")).hexdigest()[:16]


MAPPINGS = {fingerprint(m["paths"]): m | {"layout": name} for name, m in LAYOUTS.items()}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a Spark type: a.b for fields, [] for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a parsed JSON record; empty lists count as lists of nothing, empty objects as a leaf of their own kind."""
    found, left = set(), [(value, at)]
    while left:  # a record may be nested deeper than Python calls may
        value, at = left.pop()
        if isinstance(value, dict) and value:
            left += [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(v, f"{at}[]") for v in value]
        else:
            found.add(f"{at}{{}}" if isinstance(value, dict) else f"{at}[]" if isinstance(value, list) else at)
    return found


def from_struct(df: DataFrame, columns: list[str], into: str = "turns") -> DataFrame:
    """df with canonical turns, read from the given columns by the mapping that their schema's fingerprint selects.

    Raises ValueError if no mapping has that fingerprint. Null roles and texts become empty; a null list has no turns; a column that is
    already named `into` is replaced unless it is one of the columns read.
    """
    paths = [p for c in columns for p in schema_paths(df.schema[c].dataType, c)]
    mapping = MAPPINGS.get(fingerprint(paths))
    if mapping is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
    clean = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    if "list" in mapping:
        roles = mapping.get("roles", {})
        named = lambda r: F.coalesce(*[F.when(r == a, b) for a, b in roles.items()], r) if roles else r
        items = F.col(f"`{mapping['list']}`")
        if "order" in mapping:
            items = F.array_sort(F.transform(items, lambda t: F.struct(t[mapping["order"]].alias("o"), clean(t[mapping["role"]]).alias("role"), clean(t[mapping["text"]]).alias("text"))))
            turns = F.transform(items, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        else:
            turns = F.transform(items, lambda t: F.struct(named(clean(t[mapping["role"]])).alias("role"), clean(t[mapping["text"]]).alias("text")))
    else:
        col = lambda p: F.col(".".join(f"`{x}`" for x in p.split(".")))
        turns = F.array(*[F.struct(F.lit(role).alias("role"), _joined([clean(col(p)) for p in paths]).alias("text")) for role, paths in mapping["fixed"]])
        turns = F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.withColumn(into, F.coalesce(turns, F.array().cast(TURNS)).cast(TURNS))


def _joined(texts: list[Column]) -> Column:
    return texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can escape and UTF-8 cannot hold, become replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _text(value) -> str:
    return "" if value is None else _clean(value) if isinstance(value, str) else _clean(json.dumps(value, ensure_ascii=False))


def _record_turns(value) -> tuple[str | None, list[dict] | None]:
    """Layout and turns of a record; nulls where no mapping fits its paths or its values aren't of the kinds that the mapping needs."""
    found = MAPPINGS.get(fingerprint(value_paths(value)))
    if found is None:
        return None, None
    if "list" in found:
        items = value[found["list"]]
        if not isinstance(items, list) or not all(isinstance(t, dict) for t in items):
            return None, None
        if "order" in found:
            orders = [t.get(found["order"]) for t in items]
            if not all(o is None or isinstance(o, int | float) and not isinstance(o, bool) for o in orders):
                return None, None
            items = sorted(items, key=lambda t: (t.get(found["order"]) is not None, t.get(found["order"]) or 0))
        named = found.get("roles", {})
        roles = [_text(t.get(found["role"])) for t in items]
        return found["layout"], [{"role": named.get(r, r), "text": _text(t.get(found["text"]))} for r, t in zip(roles, items, strict=True)]

    def at(path: str):
        v = value
        for part in path.split("."):
            v = v[part]
        return _text(v)

    turns = [{"role": role, "text": "\n\n".join(x for x in map(at, paths) if x)} for role, paths in found["fixed"]]
    return found["layout"], [t for t in turns if t["role"] != "system" or t["text"]]


def from_json_records(records: Column) -> Column:
    """Canonical turns of JSON records of mixed layouts, each by its own fingerprint: a struct of fingerprint, layout and turns.

    A record of an unknown layout, or with turn orders that aren't all numbers, keeps its fingerprint and has null layout and turns, so
    that it can be counted and mapped; text that isn't a JSON object has a null fingerprint as well. Roles and texts that aren't strings
    are taken as JSON; lone surrogates become replacement characters.
    """
    return F.arrow_udf(_from_json_records, f"struct<fingerprint: string, layout: string, turns: {TURNS}>")(records)


def _from_json_records(records: pa.Array) -> pa.Array:
    out = []
    for raw in records.to_pylist():
        try:
            value = json.loads(raw)
        except (TypeError, ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            layout, turns = _record_turns(value)
            out.append({"fingerprint": fingerprint(value_paths(value)), "layout": layout, "turns": turns})
        else:
            out.append({"fingerprint": None, "layout": None, "turns": None})
    return pa.array(out, pa.struct([("fingerprint", pa.string()), ("layout", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]))


# ---- template -------------------------------------------------------------------------------------------------
# A turn is  <|turn|>role NEWLINE text <|end|> NEWLINE.  In roles and texts a backslash stands before every backslash, "<" and "[",
# so no control string of this or another common template survives inside a text; newlines of roles become \n.

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_SPECIAL = r"([\\<\[])"
# Stretches without an escape are taken at once and nothing is given back, so that memory doesn't grow with a turn's characters.
_TURN = re.compile(r"<\|turn\|>((?>[^\\<\n]++|\\.)*+)\n((?>[^\\<]++|\\.)*+)<\|end\|>\n", re.S)
#: Characters that are unescaped at a time.
_PIECE = 1 << 20


def escaped(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(text, _SPECIAL, r"\\$1")
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: str, role: bool = False) -> str:
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        end += (end - len(text[at:end].rstrip("\\")) - at) % 2  # not between a backslash and what it escapes
        parts.append(re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text[at:end], flags=re.S))
        at = end
    return "".join(parts)


def formatted(df: DataFrame, turns: str = "turns", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """df with formatted (string) and loss_spans (array of start and end, in characters of formatted: the texts of trained roles).

    No turns give an empty string and no spans. A turn without text has an empty span. Columns of these names are replaced.
    """
    cut = F.transform(F.col(f"`{turns}`"), lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))
    step = lambda s, t: F.struct(
        (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
        F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("first"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, end: int>>").alias("spans"))
    own = f"{unused(df, '_own')}cut"
    df = df.withColumn(own, cut)
    return df.withColumn("formatted", F.array_join(F.transform(own, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")).withColumn("loss_spans", F.aggregate(own, none, step, lambda s: s["spans"])).drop(own)


def parse(text: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted text; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


_READ = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(text: Column, spans: Column) -> Column:
    """Counts and digests of formatted texts, from the texts and their loss spans alone."""
    return F.arrow_udf(_read_back, "struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>")(text, spans)


def _read_back(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, loss in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns = parse(text)
        learned = "".join(unescape(text[s["first"] : s["end"]]) for s in loss)
        out.append({"n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(text)})
    return pa.array(out, _READ)


def conversations(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record per conversation, in layout "rows": id_col and turns (order, role, text).

    Gathers a conversation in one row, as training records are; rows that share an order go by role and text, null orders first; null
    ids form one conversation. Repeated rows are repeated turns. Other columns are ignored.
    """
    turn = F.struct(F.col(f"`{order_col}`").alias("order"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    return rows.groupBy(F.col(f"`{id_col}`").alias(id_col)).agg(F.collect_list(turn).alias("turns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all conversations and conversation -1.

    A conversation arrives in one of three layouts, by a hash of its id: rows with a turn order, a list of messages, or such a list as a
    JSON record, read by the fingerprint of each record.
    """
    probe = "</s>[INST] ok [/INST]"
    rows = conversations(table(spark, sf_dir, "conversations"))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    said = F.transform(F.array_sort(F.transform("turns", lambda t: F.struct(t["order"].alias("o"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    extra = spark.createDataFrame([(-1, [("user", probe), ("assistant", probe)])], "conv_id long, messages array<struct<role: string, content: string>>")
    messages = rows.filter(kind == 1).select("conv_id", said.alias("messages"))
    records = rows.filter(kind == 2).select("conv_id", F.to_json(F.struct(said.alias("messages"))).alias("record"))
    turns = from_struct(rows.filter(kind == 0), ["turns"]).select("conv_id", "turns")
    for more in (messages, extra):
        turns = turns.unionByName(from_struct(more, ["messages"]).select("conv_id", "turns"))
    turns = turns.unionByName(records.select("conv_id", from_json_records(F.col("record"))["turns"].alias("turns")))
    return formatted(turns).select("conv_id", read_back(F.col("formatted"), F.col("loss_spans")).alias("r")).select("conv_id", "r.*")


#: Lengths and hashes of the same turns; escapes add a character for each backslash, "<", "[" and newline of a role.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || chr(10) || '<|end|>' || chr(10)) + length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) + length(role) - length(replace(role, chr(10), ''))
      + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
