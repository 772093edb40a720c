"""Markup to nodes: an event parser inside Arrow batches.

One pass over a document gives a row for each element, text, comment and processing instruction, with
its interval (pre, post), its depth, what validation needs of its children and rendering of its
ancestors, so that no later step recurses or joins nodes with nodes.  Entity declarations are
refused: nothing is expanded or fetched."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN = {"iml", "utterance", "prosody", "emphasis", "segment", "pause"}
NODES = (
    "doc_id long, pre int, post int, parent_pre int, depth int, utt_idx int, kind string, tag string, parent_tag string, text string, "
    "attrs map<string,string>, line int, fmt_depth int, in_segment boolean, live boolean, inside boolean, error string, "
    # under an unknown element; utterances of a root; leading text, and child nodes, of a pause
    "hidden boolean, n_utterances int, pause_text boolean, pause_nodes boolean, "
    # prosody and emphasis around a text, from the outside in
    "styles array<struct<kind:string,pitch:string,volume:string,level:string>>"
)
_STYLES = pa.list_(pa.struct([(x, pa.string()) for x in ("kind", "pitch", "volume", "level")]))


class _Refused(Exception):
    pass


class _Parser:
    """Collects the node rows of one document."""

    def __init__(self, doc_id: int):
        self.doc, self.rows, self.stack, self.clock, self.utterance = doc_id, [], [], 0, -1
        self.held: list[str] = []
        self.held_line = 0

    def parse(self, markup: str) -> list[dict]:
        p = self.p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        p.CommentHandler = lambda text: self.leaf("comment", text)
        p.ProcessingInstructionHandler = lambda target, data: self.leaf("pi", f"{target} {data}")
        p.EntityDeclHandler = self.refuse
        try:
            p.Parse(markup.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError as e:
            return [self.failed(str(e), e.lineno)]
        except _Refused:
            return [self.failed("entity declarations are refused", p.CurrentLineNumber)]
        return self.rows

    def failed(self, message: str, line: int) -> dict:
        return dict.fromkeys(_FIELDS) | {"doc_id": self.doc, "pre": -1, "post": -1, "kind": "error", "error": message, "line": line}

    def refuse(self, *_: object) -> None:
        raise _Refused

    def node(self, kind: str, tag: str | None, text: str | None, attrs: dict[str, str] | None) -> dict:
        self.flush()
        up = self.stack[-1] if self.stack else None
        row = {
            "doc_id": self.doc, "pre": self.clock, "post": self.clock, "parent_pre": up["pre"] if up else -1, "depth": len(self.stack),
            "utt_idx": self.utterance if up else -1, "kind": kind, "tag": tag, "parent_tag": up["tag"] if up else None, "text": text, "attrs": attrs,
            "line": self.p.CurrentLineNumber, "fmt_depth": 0, "in_segment": False, "live": False, "inside": False, "error": None,
            "hidden": bool(up) and (up["hidden"] or (up["kind"] == "unknown" and up["depth"] > 0)),
            "n_utterances": 0, "pause_text": False, "pause_nodes": False, "styles": None,
        }
        if up:
            up["n_utterances"] += kind == "utterance"
            if up["kind"] == "pause":
                # leading text only: what stands before the first child node
                up["pause_text"] |= kind == "text" and row["pre"] == up["pre"] + 1 and text.strip(" ") != ""
                up["pause_nodes"] |= kind != "text"
        self.clock += 1
        self.rows.append(row)
        return row

    def start(self, name: str, attrs: dict[str, str]) -> None:
        tag = name.rpartition(":")[2]
        row = self.node(tag if tag in KNOWN else "unknown", tag, None, dict(attrs))
        up = self.stack[-1] if self.stack else None
        kind = row["kind"]
        # which nodes a validation walk reaches, and which belong to an utterance's content
        if up is None:
            row["live"] = kind in ("iml", "utterance")
        elif up["kind"] == "iml" and up["depth"] == 0:
            row["live"] = kind in ("utterance", "unknown")
        else:
            row["live"] = up["live"] and up["kind"] not in ("unknown", "pause", "iml") and kind != "iml"
        if kind == "utterance" and (up is None or (up["kind"] == "iml" and up["depth"] == 0)):
            self.utterance += 1
            row["utt_idx"], row["inside"] = self.utterance, True
        elif up is not None:
            row["inside"] = up["inside"] and up["kind"] not in ("pause",)
        # depth of nested formatting starts anew in utterances and segments
        fresh = kind in ("utterance", "segment", "iml") or up is None
        row["fmt_depth"] = 0 if fresh else up["fmt_depth"] + (kind in ("prosody", "emphasis"))
        row["in_segment"] = bool(up) and (up["in_segment"] or up["kind"] == "segment") and kind != "utterance"
        self.stack.append(row)

    def end(self, _: str) -> None:
        self.flush()
        self.stack.pop()["post"] = self.clock - 1

    def data(self, text: str) -> None:
        if not self.held:
            self.held_line = self.p.CurrentLineNumber
        self.held.append(text)

    def flush(self) -> None:
        if self.held and self.stack:
            text, self.held = "".join(self.held), []
            row = self.node("text", None, text, None)
            row["line"], row["inside"] = self.held_line, self.stack[-1]["inside"] and self.stack[-1]["kind"] != "pause"
            row["styles"] = [
                {"kind": x["kind"], **{a: x["attrs"].get(a) for a in ("pitch", "volume", "level")}}
                for x in self.stack if x["inside"] and not x["hidden"] and x["kind"] in ("prosody", "emphasis")
            ]
        self.held = []

    def leaf(self, kind: str, text: str) -> None:
        row = self.node(kind, None, text, None)
        row["inside"] = bool(self.stack) and self.stack[-1]["inside"]


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` in as many tasks as the session shuffles into, which are not joined again
    where bytes are few but work is much; a stream's as they come."""
    return rows if rows.isStreaming else rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shredded(docs: DataFrame, key: str = "doc_id", column: str = "markup") -> DataFrame:
    """Nodes of every document; a document that does not parse, or is null, gives one row of kind
    'error' with the parser's message and line.

    Documents are dealt to tasks by their key (a stream's as they come): parsing costs far more than
    the exchange, and a file of one row group would otherwise be parsed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[dict] = []
                for doc, markup in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += _Parser(doc).parse(markup or "")
                columns = {}
                for name, kind in zip(_FIELDS, _KINDS, strict=True):
                    values = [r[name] for r in rows]
                    columns[name] = pa.array([list(v.items()) if v is not None else None for v in values] if name == "attrs" else values, kind)
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), column)
    return dealt(rows, "doc_id").mapInArrow(run, NODES)


class _Table:
    """The shredder as a table function."""

    def eval(self, doc_id: int, markup: str) -> Iterator[tuple]:
        for row in _Parser(doc_id).parse(markup or ""):
            yield tuple(row[name] for name in _FIELDS)


def register(spark: SparkSession, name: str = "shred_markup") -> None:
    """Make the shredder a table function of SQL: ``FROM docs, LATERAL shred_markup(doc_id, markup)``
    gives the nodes of every document, as ``shredded`` does, with no exchange."""
    spark.udtf.register(name, F.udtf(_Table, returnType=NODES))


_KINDS = [
    pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(),
    pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(),
    pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), _STYLES,
]
_FIELDS = [
    "doc_id", "pre", "post", "parent_pre", "depth", "utt_idx", "kind", "tag", "parent_tag", "text", "attrs", "line", "fmt_depth", "in_segment", "live", "inside",
    "error", "hidden", "n_utterances", "pause_text", "pause_nodes", "styles",
]
