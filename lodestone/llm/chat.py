"""Chat formatting: layouts found by a fingerprint of their field paths, turns in one template.

A record's fingerprint is a hash of those of its nested field paths that any
mapping names; the mapping with that fingerprint says how the record's fields
become turns. Typed tables have one fingerprint, taken from their schema, and
their mapping becomes column expressions. JSON records have one each.

The template writes a turn as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.
In texts and roles every ``<`` that backslashes and a ``|`` follow gets one more
backslash before the ``|``, so no text can hold a control string, and taking one
backslash away restores it. Line feeds in roles become a backslash and an n.

Defined cases: null texts are empty turns; null roles are ``unknown``; turns of
a conversation go by turn (null first), then role, then text, so repeated rows
stay; an empty table gives no row. Where known fields stand beside a layout's
own, the largest mapping whose fields are all there counts, of equal ones the
first in MAPPINGS. An empty list of turns gives no row. Records that no mapping
fits give a row without a turn, see :func:`canonical_json`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices

START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"

#: Names of roles in other layouts; in rows with a role and a text roles stay as they are (fixed values).
ALIASES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}

#: Mappings. Either ``each`` names a list and ``role`` and ``text`` fields of its items, or ``turns`` lists (role, paths):
#: a turn's text is the non-empty fields joined by an empty line, and a turn without any is left out unless it is required.
#: ``row`` is a table with a turn in each row.
MAPPINGS = [
    {"name": "messages", "each": "messages", "role": "role", "text": "content"},
    {"name": "from-value", "each": "conversations", "role": "from", "text": "value"},
    {"name": "instruction-input", "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction", "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "instruction-context", "turns": [("user", ["instruction", "context"]), ("assistant", ["response"])]},
    {"name": "system-prompt", "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt-response", "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt-completion", "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question-answer", "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "data-messages", "each": "data.messages", "role": "role", "text": "content"},
    {"name": "row", "row": True, "role": "role", "text": "text"},
]


def mapping_paths(m: dict) -> set[str]:
    """The field paths that a mapping reads; ``[]`` marks the items of a list."""
    if "each" in m:
        return {f"{m['each']}[].{m['role']}", f"{m['each']}[].{m['text']}"}
    return {m["role"], m["text"]} if m.get("row") else {p for _, paths in m["turns"] for p in paths}


def fingerprint(paths: Iterable[str]) -> str:
    """A hash of the known ones among the paths."""
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()[:16]


KNOWN = set().union(*map(mapping_paths, MAPPINGS))
BY_FINGERPRINT = {fingerprint(mapping_paths(m)): m for m in MAPPINGS}


def mapping(paths: Iterable[str]) -> dict | None:
    """The mapping with the fingerprint of the paths, else the largest that needs no other ones."""
    known = set(paths) & KNOWN
    if found := BY_FINGERPRINT.get(fingerprint(known)):
        return found
    fits = [m for m in MAPPINGS if mapping_paths(m) <= known]
    return max(fits, key=lambda m: len(mapping_paths(m)), default=None)


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Leaf paths of a schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value, at: str = "") -> Iterator[str]:
    """Leaf paths of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
        if not value:
            yield f"{at}[]"
    else:
        yield at


def _role(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(named[c], c, F.lit(UNKNOWN))


def canonical(records: DataFrame, id_col: str, turn_col: str | None = None) -> DataFrame:
    """(id, turn, role, text) of a typed table, by the mapping of its schema's fingerprint. ``turn_col`` orders the rows of a row layout."""
    found = mapping(schema_paths(records.schema))
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(schema_paths(records.schema))}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.col(id_col).alias("id")
    if found.get("row"):
        return records.select(key, F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(found["role"]).cast("string"), F.lit(UNKNOWN)).alias("role"), text(F.col(found["text"])).alias("text"))
    if "each" in found:
        turns = F.transform(F.col(found["each"]), lambda x: F.struct(_role(x[found["role"]]).alias("role"), text(x[found["text"]]).alias("text")))
    else:
        parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[text(F.col(p)) for p in paths]), lambda x: x != ""), "\n\n").alias("text")) for role, paths in found["turns"]]
        turns = F.filter(F.array(*parts), lambda t: (t["role"] != "system") | (t["text"] != ""))
    return records.select(key, F.posexplode(turns).alias("turn", "t")).select("id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_turns(record) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, turns) of a parsed record; None without a mapping."""
    paths_ = set(value_paths(record))
    mark, found = fingerprint(paths_), mapping(paths_)
    if not isinstance(record, dict):
        return mark, None
    if found is None:
        return mark, [] if any(f"{m['each']}[]" in paths_ for m in MAPPINGS if "each" in m) else None
    string = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    def at(path):
        value = record
        for name in path.split("."):
            value = value[name]
        return value

    role = lambda x: UNKNOWN if x is None else ALIASES.get(string(x), string(x))
    if found.get("row"):
        return mark, [(UNKNOWN if record[found["role"]] is None else string(record[found["role"]]), string(record[found["text"]]))]
    if "each" in found:
        return mark, [(role(x.get(found["role"])), string(x.get(found["text"]))) for x in at(found["each"]) if isinstance(x, dict)]
    turns = [(r, "\n\n".join(x for x in (string(at(p)) for p in paths) if x)) for r, paths in found["turns"]]
    return mark, [(r, t) for r, t in turns if r != "system" or t]


def whole(text: str) -> str:
    """The text with halves of surrogate pairs replaced."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, fingerprint, turn, role, text) of JSON records of any layouts. A record that no mapping fits, or that is no JSON, gives one row with null turn, role and text.

    So does one whose names only look like a mapping's paths (a dot in a name), or that is nested too deeply to be read. Half of
    a surrogate pair becomes U+FFFD.
    """
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).cast("string").alias("record"))

    def run(batches):
        for part in slices(batches, "record"):
            out = []
            for key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    mark, turns = json_turns(json.loads(text or ""))
                except (ValueError, LookupError, TypeError, RecursionError):
                    mark, turns = None, None
                turns = turns and [(whole(r), whole(t)) for r, t in turns]
                out += [(key, mark, None, None, None)] if turns is None else [(key, mark, i, r, t) for i, (r, t) in enumerate(turns)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "fingerprint", "turn", "role", "text"])

    return rows.mapInArrow(run, "id long, fingerprint string, turn long, role string, text string")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<\\" in text else text


def role_text(written: str) -> str:
    """A role as it was before it was written."""
    return unescape(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", written))


def formatted(turns: DataFrame) -> DataFrame:
    """(id, piece): the formatted conversations, a row for each turn, those of a conversation together and in order."""
    role = F.regexp_replace(F.regexp_replace(escaped(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    piece = F.concat(F.lit(START), role, F.lit("\n"), escaped(F.col("text")), F.lit(f"{END}\n"))
    return turns.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", piece.alias("piece"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parsed(piece: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the written text) of the turns in formatted text."""
    at = 0
    for m in _TURN.finditer(piece):
        if m.start() != at:
            break
        at = m.end()
        yield role_text(m[1]), unescape(m[2]), m.start(2), m.end(2)
    if at != len(piece):
        raise ValueError("not in the template")


def digests(pieces: DataFrame, learnt: str = "assistant") -> DataFrame:
    """What reading formatted conversations back gives, one row for each; the loss mask covers the texts of role ``learnt``.

    Digests run on as rows come, so a conversation of any length takes the memory of a batch. A SHA-256 can't be put
    together from parts, so the rows of one conversation have to pass one task, as a stream.
    """

    def run(batches):
        key, state = None, None

        def row():
            n, loss, chars, turns, learnt_hash = state
            return pa.RecordBatch.from_pydict({"id": pa.array([key], pa.int64()), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [loss], "loss_sha256": [learnt_hash.hexdigest()], "formatted_chars": [chars]})

        done: list = []
        for part in slices(batches, "piece"):
            for k, piece in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append(row())
                    key, state = k, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                state[2] += len(piece)
                for role, text, _, _ in parsed(piece):
                    state[0] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                    if role == learnt:
                        state[1] += len(text)
                        state[4].update(text.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield row()

    return pieces.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
