"""The elements of documents as rows, so that questions about what lies within what are joins, and edits touch the elements they mean.

Every element has a number, in the order in which elements open, and the greatest number within it: b lies within a if ``a.nr < b.nr <= a.last``. It
also has its places in the text, counted in characters: where its start tag begins and ends, where its end tag begins and ends. Edits are
splices of the text at such places. A document that can't be parsed has no rows, and edits leave it as it is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

C = F.col
NODES = "score_id long, nr long, last long, parent long, depth int, tag string, path string, attributes map<string,string>, value string, begins long, inner long, closes long, ends long"
TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")


class Reached(Exception):
    """The parser came to an element that nothing behind is wanted of."""


def node_rows(text: str, until: frozenset[str] = frozenset(), wanted: Callable[[str], bool] | None = None, known: dict | None = None) -> list[dict]:
    """The elements of a document, or those whose path is wanted; all are counted. Elements of a tag in ``until`` end the reading: what is open then has no
    end. known keeps what was said of paths from one document to the next."""
    data, rows, n = text.encode(), [], 0
    known = {} if known is None else known
    open_ = [(None, None, ("", False, known))]  # of each open element its number, its row if it is wanted, its path with what is known below it
    places = np.cumsum(np.concatenate([[0], (np.frombuffer(data, np.uint8) & 0xC0) != 0x80])) if len(data) != len(text) else None
    at = (lambda i: int(places[i])) if places is not None else int
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def start(tag: str, attributes: dict) -> None:
        nonlocal n
        up, row = open_[-1], None
        here = up[2][2].get(tag)
        if here is None:
            path = f"{up[2][0]}/{tag}"
            here = up[2][2][tag] = (path, wanted is None or wanted(path), {})
        if tag in until:
            raise Reached
        if here[1]:
            i = parser.CurrentByteIndex
            shut = TAG.match(data, i).end()
            row = {"nr": n, "last": None, "parent": up[0], "depth": len(open_) - 1, "tag": tag, "path": here[0], "attributes": attributes, "value": "", "begins": at(i), "inner": at(shut), "closes": None, "ends": None}
            rows.append(row)
            if data[shut - 2 : shut] == b"/>":
                row["closes"] = row["ends"] = row["inner"]
            parser.CharacterDataHandler = characters
        open_.append((n, row, here))
        n += 1

    def end(tag: str) -> None:
        row = open_.pop()[1]
        if row is not None:
            row["last"] = n - 1
            if row["closes"] is None:
                i = parser.CurrentByteIndex
                row["closes"], row["ends"] = at(i), at(data.index(b">", i) + 1)
            if not any(e[1] for e in open_):  # no text is wanted
                parser.CharacterDataHandler = None

    def characters(text: str) -> None:
        if (row := open_[-1][1]) is not None:
            row["value"] += text

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(data, True)
    except Reached:
        pass
    except expat.ExpatError:
        return []
    return rows


def nodes(texts: DataFrame, until: tuple[str, ...] = (), paths: str = "", every: bool = False) -> DataFrame:
    """The elements of documents (score_id, text), or those before the first one of a tag in ``until``; of these the ones in whose path the regular
    expression ``paths`` is found. every: whether each document, also one that can't be parsed, has one more row, with nr -1 and no tag."""
    schema, stop, wanted = to_arrow_schema(texts.sparkSession.createDataFrame([], NODES).schema), frozenset(until), re.compile(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = {}, []
        for batch in batches:
            for score_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if every:
                    rows.append({"score_id": score_id, "nr": -1})
                rows += [{"score_id": score_id, **r, "attributes": list(r["attributes"].items())} for r in node_rows(text or "", stop, wanted.search, known)]
                while len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows[:10_000], schema=schema)
                    rows = rows[10_000:]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.select("score_id", "text").mapInArrow(run, NODES)


def tagged_values(text: str, tags: frozenset[str]) -> tuple[list[str], list[str]]:
    """The tags and values of the elements of these tags, as node_rows has them, without a call of Python for every other element. Where the tree's parser
    names elements otherwise (namespaces) or refuses what the other one reads, that one reads."""
    if "xmlns" not in text and "xml:" not in text:
        try:
            found = [x for x in ElementTree.fromstring(text).iter() if x.tag in tags]
            return [x.tag for x in found], [(x.text or "") + "".join([c.tail for c in x if c.tail]) if len(x) else x.text or "" for x in found]
        except ElementTree.ParseError:
            pass
    rows = [r for r in node_rows(text) if r["tag"] in tags]
    return [r["tag"] for r in rows], [r["value"] for r in rows]


def tagged(texts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The elements of these tags in documents (score_id, text), wherever they stand, as score_id, tag and value: for questions that need no places."""
    wanted = frozenset(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, values = [], [], []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(values, pa.string())], ["score_id", "tag", "value"])

        for batch in batches:
            for score_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tag, value = tagged_values(text or "", wanted)
                names += tag
                values += value
                ids += [score_id] * len(tag)
                if len(ids) >= 10_000:
                    yield table()
                    ids, names, values = [], [], []
        yield table()

    return texts.select("score_id", "text").mapInArrow(run, "score_id long, tag string, value string")


def spliced(texts: DataFrame, splices: DataFrame) -> DataFrame:
    """Documents with parts of them put in others' place (score_id, begins, ends, put); those at one place in order of the column turn. Splices
    don't overlap."""
    mine = splices.filter("begins is not null").groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("begins", "ends", "turn", "put"))).alias("s"))
    text, cut = C("text"), lambda a, b: F.substr(C("text"), (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(s["ends"].alias("at"), F.concat(acc["out"], cut(acc["at"], s["begins"]), s["put"]).alias("out")))
    rows = texts.join(mine, "score_id", "left").withColumn("done", F.when(C("s").isNotNull(), done))
    return rows.withColumn("text", F.when(C("s").isNull(), text).otherwise(F.concat("done.out", cut(C("done.at"), F.length(text))))).drop("s", "done")


def tempo_only(directions: DataFrame, every: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(score_id, nr, only) of directions: whether all they hold is sounds and metronomes. without: elements (score_id, nr) that don't count."""
    inside = every if without is None else every.join(without.select("score_id", "nr"), ["score_id", "nr"], "left_anti")
    child = inside.select("score_id", C("nr").alias("child"), C("parent").alias("nr"), C("tag").alias("child_tag"))
    types = inside.groupBy("score_id", C("parent").alias("child")).agg(F.bool_and(C("tag") == "metronome").alias("plain"))
    fine = F.when(C("child_tag") == "sound", True).when(C("child_tag") == "direction-type", F.coalesce("plain", F.lit(False))).otherwise(False)
    found = directions.select("score_id", "nr").join(child, ["score_id", "nr"]).join(types, ["score_id", "child"], "left").groupBy("score_id", "nr").agg(F.bool_and(fine).alias("only"))
    return directions.select("score_id", "nr").join(found, ["score_id", "nr"], "left").select("score_id", "nr", F.coalesce("only", F.lit(True)).alias("only"))


def opened(start_tag: Column) -> Column:
    """A start tag as one that does not end its element at once."""
    return F.regexp_replace(start_tag, r"\s*/>$", ">")
