"""Reading and writing score documents. Element order matters in them, so a document becomes one row per element.

Parsing XML is the one step here that needs Python workers; everything before and after is native. Documents that can't be
parsed go to an errors table with the reason. A document is parsed in one piece, as it is one row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stavework.functions import rhythm as R
from stavework.operators import cursor as O
from stavework.operators.windows import MEASURE

from . import structure as X
from .adapters import once

C = F.col
ELEMENTS = "score_id long, part_idx int, measure_idx int, elem_idx int, tag string, is_chord boolean, is_grace boolean, is_rest boolean, duration int, staff int, voice int, step string, alter int, octave int, type string, dot boolean, tie_start boolean, tie_stop boolean, slash boolean, staccato boolean, play_duration int, full_measure boolean, note_duration int, number int, divisions int, staves int, fifths int, mode string, beats int, beat_type int, senza_misura boolean, clefs array<struct<staff:int,sign:string,line:int>>, repeat_start boolean, repeat_times int, error string"
#: What only rows of measures say; what backups and forwards don't, from step on; the elements that are rows.
OF_MEASURE = ("number", "divisions", "staves", "fifths", "mode", "beats", "beat_type", "senza_misura", "clefs", "repeat_start", "repeat_times")
SILENT = [None] * 12
HELD = frozenset(("note", "backup", "forward"))
#: Files that are packed or unpacked together.
FILES = 128
INTEGER = re.compile(r"\s*([+-]?\d+)")
#: Whole numbers as documents mostly write them.
WRITTEN = {str(n): n for n in range(-100, 1000)}


def file_kind(name: Column) -> Column:
    """What to do with a file, by its name's ending."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.mxl$"), "mxl").when(low.rlike(r"\.midi?$"), "midi").when(low.rlike(r"\.(png|jpe?g|webp|gif|bmp|pdf)$"), "image").otherwise("text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as path, kind and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", file_kind(C("path")).alias("kind"), "content")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the score documents in a folder and those below it, with the path of each; score_id is a hash of the path. Spark packs files into
    tasks by their size. Compressed documents are unpacked; other kinds of files are left out, and what can't be read is a row with an error."""
    files = read_files(spark, path)
    plain = files.filter("kind = 'text'").select("path", F.expr("try_validate_utf8(content)").cast("string").alias("text"))
    texts = plain.withColumn("error", F.when(C("text").isNull(), "no text")).unionByName(unpacked(files.filter("kind = 'mxl'")))
    texts = texts.withColumn("score_id", F.xxhash64("path"))
    bad = texts.filter("text is null").select("path", "score_id", "error")
    return parsed(texts.filter("text is not null"), "path").unionByName(bad, allowMissingColumns=True)


def write_scores(texts: DataFrame, path: str) -> None:
    """Documents (score_id, text) as files, one for each score in a folder of its own, under Spark's commit of tasks: a task that is tried again leaves no
    second file."""
    texts.select("score_id", "text").repartition("score_id").write.partitionBy("score_id").option("lineSep", "\n").text(path)


def write_collection(texts: DataFrame, path: str) -> None:
    """Documents (path, text) as files that hold many of them each: millions of small files cost a store, and the driver that commits and lists them, more than
    their contents do."""
    texts.select("path", "text").write.parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the score documents in the files of write_collection, as read_scores gives them."""
    texts = spark.read.schema("path string, text string").parquet(path).withColumn("score_id", F.xxhash64("path"))
    bad = texts.filter("text is null").select("path", "score_id", F.lit("no text").alias("error"))
    return parsed(texts.filter("text is not null"), "path").unionByName(bad, allowMissingColumns=True)


def integer(text: str | None, default: int | None = None) -> int | None:
    if (known := WRITTEN.get(text)) is not None:
        return known
    if text and text.isdecimal():
        return int(text)
    m = INTEGER.match(text or "")
    return int(m[1]) if m else default


def repeat_marks(measure: ElementTree.Element) -> tuple[bool, int | None]:
    """Whether a repeat begins with a measure, and how often what it ends is played (twice, if that is not said)."""
    starts, times = False, None
    for repeat in measure.iterfind("barline/repeat"):
        if repeat.get("direction") == "forward":
            starts = True
        elif repeat.get("direction") == "backward":
            times = integer(repeat.get("times", "2"), 2)
    return starts, times


def measure_row(measure: ElementTree.Element) -> dict:
    """What a measure says about itself; null where it says nothing."""
    starts, times = repeat_marks(measure)
    row = {"number": integer(measure.get("number", "1")), "repeat_start": starts, "repeat_times": times, "clefs": []}
    for a in measure.iterfind("attributes"):
        known = {"divisions": integer(a.findtext("divisions")), "staves": integer(a.findtext("staves"))}
        if (key := a.find("key")) is not None:
            known |= {"fifths": integer(key.findtext("fifths", "0")), "mode": key.findtext("mode", "major")}
        if (time := a.find("time")) is not None:
            known |= {"beats": integer(time.findtext("beats")), "beat_type": integer(time.findtext("beat-type")), "senza_misura": time.find("senza-misura") is not None}
        row |= {k: v for k, v in known.items() if v is not None and row.get(k) is None}
        row["clefs"] += [{"staff": integer(c.get("number", "1"), 1), "sign": c.findtext("sign", "G"), "line": integer(c.findtext("line", "2"), 2)} for c in a.iterfind("clef")]
    return row


def element_row(x: ElementTree.Element) -> tuple:
    """What a note, backup or forward says, in order of ELEMENTS from tag to note_duration. A staccato note sounds half of what it lasts."""
    first, pitches, starts, stops = {}, 0, False, False
    for c in x:
        tag = c.tag
        if tag == "pitch":
            pitches += 1
        elif tag == "tie":
            kind = c.get("type")
            starts, stops = starts or kind == "start", stops or kind == "stop"
        if tag not in first:  # of children of one tag the first counts
            first[tag] = c
        if len(c) and tag != "pitch" and tag != "notations":  # ties may lie deeper
            starts, stops = starts or any(t.get("type") == "start" for t in c.iter("tie")), stops or any(t.get("type") == "stop" for t in c.iter("tie"))
    long, on, of = first.get("duration"), first.get("staff"), first.get("voice")
    duration, staff, voice = 0 if long is None else integer(long.text, 0), 1 if on is None else integer(on.text, 1), 1 if of is None else integer(of.text, 1)
    if x.tag != "note":
        return x.tag, None, None, None, duration, staff, voice, *SILENT
    grace, rest, notations = first.get("grace"), first.get("rest"), first.get("notations")
    if pitches < 2:
        pitch = {c.tag: c.text or "" for c in reversed(first["pitch"])} if pitches else {}
    else:  # whichever has it
        pitch = {tag: t for tag in ("step", "alter", "octave") if (t := x.findtext(f"pitch/{tag}")) is not None}
    box = first.get("pitch") if pitches < 2 else x
    if pitches == 1 and "tie" not in pitch and not any(map(len, box)):
        box = None  # no tie lies in it
    for box in (box, notations):
        if box is not None:
            kinds = {t.get("type") for t in box.iter("tie")}
            starts, stops = starts or "start" in kinds, stops or "stop" in kinds
    staccato = notations is not None and x.find("notations/articulations/staccato") is not None
    whole = rest is not None and rest.get("measure") == "yes"
    # a note that doesn't say how long it is lasts 4, though time goes on by nothing; a grace lasts nothing
    lasts = 0 if grace is not None else integer(long.text) if long is not None else 4
    kind = first.get("type")
    return ("note", "chord" in first, grace is not None, rest is not None, duration, staff, voice, pitch.get("step", "C"), integer(pitch.get("alter"), 0), integer(pitch.get("octave"), 4), kind is not None and kind.text or ("whole" if whole else "quarter"), "dot" in first, starts, stops,
            grace is not None and grace.get("slash") == "yes", staccato, max(1, duration // 2) if staccato and duration else duration, whole, lasts)


def score_rows(score_id: int, xml: str, also: tuple = (), elements: bool = True) -> tuple[list[tuple], list[tuple]]:
    """The rows of a document, each with also behind its place: those of measures, one each, and those of elements."""
    root = ElementTree.fromstring(xml)
    measures, rows = [], []
    for part_idx, part in enumerate(root.iter("part")):
        for measure_idx, measure in enumerate(part.iter("measure")):
            said, place = measure_row(measure), (score_id, part_idx, measure_idx, *also)
            measures.append((*place, *[said.get(c) for c in OF_MEASURE]))
            if elements:
                rows += [(*place, at, *element_row(x)) for at, x in enumerate([x for x in measure if x.tag in HELD])]
    return measures, rows


def parsed(texts: DataFrame, *also: str, elements: bool = True) -> DataFrame:
    """All rows of documents (score_id, text), errors included, with further string columns: one an element, and one without a tag for each measure. elements:
    whether those of elements are wanted."""
    named = ELEMENTS + "".join(f", {c} string" for c in also)
    schema = to_arrow_schema(texts.sparkSession.createDataFrame([], named).schema)
    place = [*MEASURE, *also]
    kinds = {"measures": [*place, *OF_MEASURE], "elements": [*place, *[f.name for f in schema][3:23]], "errors": ["score_id", *also, "error"]}

    def table(kind: str, rows: list[tuple]) -> pa.RecordBatch:
        """Rows that all say the same columns; the others are null."""
        said = dict(zip(kinds[kind], zip(*rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(said[f.name], f.type) if f.name in said else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: [] for kind in kinds}
        for batch in batches:
            for score_id, text, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    for kind, rows in zip(("measures", "elements"), score_rows(score_id, text or "", tuple(more), elements), strict=True):
                        held[kind] += rows
                except ElementTree.ParseError as e:
                    held["errors"].append((score_id, *more, str(e)))
                for kind, rows in held.items():
                    for k in range(0, len(rows) - len(rows) % 10_000, 10_000):
                        yield table(kind, rows[k : k + 10_000])
                    if len(rows) >= 10_000:
                        held[kind] = rows[len(rows) - len(rows) % 10_000 :]
        for kind, rows in held.items():
            if rows:
                yield table(kind, rows)

    return texts.select("score_id", "text", *also).mapInArrow(run, named)


def parsed_measures(rows: DataFrame) -> DataFrame:
    """The measures of parsed documents as a table that the operators read."""
    return rows.filter("tag is null and error is null").select(*MEASURE, "number", "divisions", "staves", "fifths", "mode", "beats", "beat_type", "senza_misura", "repeat_start", "repeat_times")


def parsed_clefs(rows: DataFrame) -> DataFrame:
    """The declared clefs of parsed documents."""
    return rows.filter("tag is null and error is null").select(*MEASURE, F.explode("clefs").alias("c")).select(*MEASURE, "c.*")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of FILES rows, so that no more files than that are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, FILES):
            yield batch.slice(k, FILES)


def unpacked(files: DataFrame) -> DataFrame:
    """The root score of compressed files (path, content): the one that the container names, or else the first score that is
    no metadata; null and an error if there is none."""

    def root(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "META-INF/container.xml" in names:
                found = [x.get("full-path") for x in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if x.tag.rpartition("}")[2] == "rootfile"]
            else:
                found = []
            found = [n for n in found if n in names] or [n for n in names if not n.startswith("META-INF/") and n.lower().endswith((".xml", ".musicxml"))]
            return z.read(found[0]).decode("utf-8")

    def read(content: bytes) -> tuple[str | None, str | None]:
        try:
            return root(bytes(content)), None
        except (zipfile.BadZipFile, ElementTree.ParseError, IndexError, UnicodeDecodeError, TypeError) as e:
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [read(content) for content in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def packed(texts: DataFrame) -> DataFrame:
    """Documents (path, text) as compressed files."""

    def pack(text: str) -> bytes:
        with zipfile.ZipFile(b := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="score.xml"/></rootfiles></container>')
            z.writestr("score.xml", text)
        return b.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(t) for t in part.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return texts.select("path", "text").mapInArrow(run, "path string, content binary")


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))).otherwise("")


def escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _flag(name: str, text: str, columns: list[str]) -> Column:
    """The text where the column, if there is one, holds."""
    return F.when(C(name), text).otherwise("") if name in columns else F.lit("")


def element_text(columns: list[str]) -> Column:
    """An element's XML, from a table with these columns."""
    rest = F.when(C("full_measure"), '<rest measure="yes"/>').otherwise("<rest/>") if "full_measure" in columns else F.lit("<rest/>")
    pitch = F.when(C("is_rest"), rest).otherwise(F.concat(F.lit("<pitch>"), _tag("step", C("step")), _tag("alter", C("alter")), _tag("octave", C("octave")), F.lit("</pitch>")))
    grace = F.when(C("is_grace"), F.when(C("slash"), '<grace slash="yes"/>').otherwise("<grace/>")).otherwise("")
    flag = lambda c, text: F.when(C(c), text).otherwise("")
    slurs = [_flag("slur_start", '<slur type="start"/>', columns), _flag("slur_stop", '<slur type="stop"/>', columns)]
    tied = [F.when(C("tied") & C(f"tie_{kind}"), f'<tied type="{kind}"/>').otherwise("") for kind in ("stop", "start")] if "tied" in columns else []
    marks = F.concat(*tied, *slurs, _flag("staccato", "<articulations><staccato/></articulations>", columns))
    printed = F.when(C("accidental") != "none", _tag("accidental", C("accidental"))).otherwise("") if "accidental" in columns else F.lit("")
    beams = F.coalesce(F.array_join(F.transform("beams", lambda b: F.concat(F.lit('<beam number="'), b["level"].cast("string"), F.lit('">'), b["beam"], F.lit("</beam>"))), ""), F.lit("")) if "beams" in columns else F.lit("")
    notations = F.when(marks != "", F.concat(F.lit("<notations>"), marks, F.lit("</notations>"))).otherwise("")
    note = F.concat(F.lit("<note>"), grace, flag("is_chord", "<chord/>"), pitch, _tag("duration", C("duration")), flag("tie_start", '<tie type="start"/>'), flag("tie_stop", '<tie type="stop"/>'), _tag("voice", C("voice")), _tag("type", C("type")), flag("dot", "<dot/>"), printed, _tag("staff", C("staff")), beams, notations, F.lit("</note>"))
    return F.when(C("tag") == "note", note).otherwise(F.concat(F.lit("<"), C("tag"), F.lit(">"), _tag("duration", C("duration")), F.lit("</"), C("tag"), F.lit(">")))


def attributes_text(columns: list[str]) -> Column:
    """A measure's attributes, from a table with these columns; clefs is an array of staff, sign and line, or there is none."""
    has = lambda c: C(c) if c in columns else F.lit(None).cast("string")
    key = F.when(C("fifths").isNotNull(), F.concat(F.lit("<key>"), _tag("fifths", C("fifths")), _tag("mode", has("mode")), F.lit("</key>"))).otherwise("")
    time = F.when(C("beats").isNotNull(), F.concat(F.lit("<time>"), _tag("beats", C("beats")), _tag("beat-type", C("beat_type")), F.lit("</time>"))).otherwise(_flag("senza_misura", "<time><senza-misura/></time>", columns))
    clefs = F.lit("")
    if "clefs" in columns:
        one = lambda c: F.concat(F.lit('<clef number="'), c["staff"].cast("string"), F.lit('">'), _tag("sign", c["sign"]), _tag("line", c["line"]), F.lit("</clef>"))
        clefs = F.coalesce(F.array_join(F.transform(F.array_sort("clefs"), one), ""), F.lit(""))
    inner = F.concat(_tag("divisions", C("divisions")), key, time, _tag("staves", has("staves")), clefs)
    return F.when(inner != "", F.concat(F.lit("<attributes>"), inner, F.lit("</attributes>"))).otherwise("")


def barlines_text(columns: list[str]) -> tuple[Column, Column]:
    """The barlines before and after what a measure holds: where repeats begin and end."""
    if "repeat_times" not in columns:
        return F.lit(""), F.lit("")
    end = F.when(C("repeat_times").isNotNull(), F.concat(F.lit('<barline location="right"><repeat direction="backward" times="'), C("repeat_times").cast("string"), F.lit('"/></barline>'))).otherwise("")
    return F.when(C("repeat_start"), '<barline location="left"><repeat direction="forward"/></barline>').otherwise(""), end


def engraved(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """Elements with what an engraver adds: printed accidentals, beams (of each staff and voice, chord tails and graces left out, in the meter in force), and
    the curves of ties."""
    known = elements.filter("tag = 'note'")
    accidentals = O.printed_accidentals(elements, measures).select(*MEASURE, "elem_idx", "accidental")
    meter = O.carried_attributes(measures).select(*MEASURE, "active_beats", "active_beat_type")
    n = F.when(C("is_rest"), 0).otherwise(R.by_name(C("type"), {t: {"eighth": 1, "16th": 2}.get(t, 0) for t, _, _ in R.NOTE_VALUES}))
    length = R.by_name(C("type"), {t: int(q * 4) for t, dot, q in R.NOTE_VALUES if not dot})
    stream = known.filter("not is_chord and not is_grace").join(meter, list(MEASURE))
    beams = O.beams(stream, (*MEASURE, "staff", "voice"), ["elem_idx"], C("active_beats"), C("active_beat_type"), n, length)
    lists = beams.groupBy(*MEASURE, "elem_idx").agg(F.array_sort(F.collect_list(F.struct("level", "beam"))).alias("beams"))
    return elements.join(accidentals, [*MEASURE, "elem_idx"], "left").join(lists, [*MEASURE, "elem_idx"], "left").withColumn("tied", F.lit(True))


def exported(elements: DataFrame, measures: DataFrame, metadata: DataFrame | None = None, part_list: bool = False) -> DataFrame:
    """score_id and the text of its document. Measures may also have number, mode, staves, clefs, senza_misura and repeat marks, elements
    slurs, staccato, full_measure and what `engraved` adds. metadata: score_id and any fields that metadata() reads, encoding and import fields included;
    a tempo is put at the beginning of the first measure. part_list: whether the list of parts, which readers of the format want, is written."""
    number = F.coalesce("number", C("measure_idx") + 1) if "number" in measures.columns else C("measure_idx") + 1
    left, right = barlines_text(measures.columns)
    # As many tasks as shuffles have, for what takes longer than its bytes tell, by which tasks would be merged
    n = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    measures = measures.repartition(n)
    # all pieces of a score, in order: what opens a measure, its left barline, its elements, and what closes it. One number tells a piece's part and measure (code),
    # one its kind and its place (at), so that few comparisons put them in order
    code, low = F.shiftleft(C("part_idx").cast("long"), 32) + C("measure_idx").cast("int"), -(1 << 31)
    piece = lambda kind, at, x: F.struct(code.alias("code"), (F.lit(kind << 32) + F.coalesce(at.cast("int"), F.lit(low))).alias("at"), x.alias("x"))
    head = F.concat(F.lit('<measure number="'), number.cast("string"), F.lit('">'), attributes_text(measures.columns))
    inner = elements.select("score_id", piece(1, C("elem_idx"), element_text(elements.columns)).alias("p"))
    outer = measures.select("score_id", F.explode(F.array_compact(F.array(piece(0, F.lit(0), head), F.when(left != "", piece(0, F.lit(1), left)), piece(2, F.lit(0), F.concat(right, F.lit("</measure>")))))).alias("p"))
    # dealt out and gathered once by score; a score is one row in the end
    dealt = inner.unionByName(outer).filter("p.code is not null").repartition(n, "score_id")
    found = dealt.groupBy("score_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.collect_list(F.when(C("p.at") == 0, C("p.code"))).alias("heads"))
    found = found.withColumn("lost", F.array_except("p.code", "heads"))  # elements of measures that are not there
    kept = F.when(F.size("lost") > 0, F.filter("p", lambda p: ~F.array_contains("lost", p["code"]))).otherwise(C("p"))
    found = found.withColumn("p", kept).filter(F.size("p") > 0)
    number_of = lambda x: F.shiftright(x - low, 32).cast("int")  # the upper half of a code or a place
    first, last = F.get("p", F.lit(0)), F.get("p", F.size("p") - 1)
    # a score of one part, each of whose measures is there once: its pieces are joined as they are
    found = found.withColumn("plain", (F.size("heads") == F.size(F.array_distinct("heads"))) & (number_of(first["code"]) == number_of(last["code"])))
    tempo = F.lit("")
    if metadata is not None:
        found = found.join(metadata, "score_id", "left")
        if "tempo" in metadata.columns:
            tempo = F.when(C("tempo").isNotNull(), tempo_text(escaped(C("tempo").cast("string")))).otherwise("")
    begin = lambda part: F.concat(F.lit('<part id="P'), (part + 1).cast("string"), F.lit('">'))

    def text(p: Column, i: Column) -> Column:
        """A piece with what begins a part before it. Of pieces of measures at one place the last counts."""
        up, after = F.get(C("p"), i - 1), F.get(C("p"), i + 1)
        again = (number_of(p["at"]) != 1) & F.coalesce((after["at"] == p["at"]) & (after["code"] == p["code"]), F.lit(False))
        part = number_of(p["code"])
        opens = F.when((i > 0) & (number_of(up["code"]) == part), "").otherwise(F.concat(F.when(i > 0, "</part>").otherwise(""), begin(part)))
        return F.concat(opens, F.when(again, "").otherwise(F.concat(p["x"], F.when(i == 0, tempo).otherwise(""))))

    one = lambda n: F.concat(F.lit('<score-part id="P'), (n + 1).cast("string"), F.lit('"><part-name>Part '), (n + 1).cast("string"), F.lit("</part-name></score-part>"))
    parts = F.when(C("plain"), one(number_of(first["code"]))).otherwise(F.array_join(F.transform(F.array_distinct(F.transform("p", lambda p: number_of(p["code"]))), one), ""))
    listed = F.concat(F.lit("<part-list>"), parts, F.lit("</part-list>")) if part_list else F.lit("")
    plain = F.concat(begin(number_of(first["code"])), first["x"], tempo, F.array_join(F.slice("p.x", F.lit(2), F.size("p")), ""))
    texts = found.withColumn("parts", F.concat(listed, F.when(C("plain"), plain).otherwise(F.array_join(F.transform("p", text), "")), F.lit("</part>")))
    head = F.lit("") if metadata is None else head_text(metadata.columns)
    return texts.select("score_id", F.concat(F.lit('<score-partwise version="4.0">'), head, C("parts"), F.lit("</score-partwise>")).alias("text"))


#: Fields of a score's metadata, named as the elements, types and names of the document format that hold them.
CREATORS = ("composer", "lyricist", "arranger")
ENCODING = ("software", "encoding_date", "encoding_description", "encoder")
IMPORTS = ("import_method", "import_source_file", "import_date")
FIELDS = ("title", "movement_title", *CREATORS, "rights", "source")


def head_text(columns: list[str]) -> Column:
    """What stands before the parts of a document, from metadata with these columns; nothing for fields that are null."""
    text = lambda c: F.when(C(c).isNotNull(), escaped(C(c).cast("string"))) if c in columns else F.lit(None).cast("string")
    full = lambda name, inner: F.when(inner != "", F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise("")
    creators = [F.when(text(c).isNotNull(), F.concat(F.lit(f'<creator type="{c}">'), text(c), F.lit("</creator>"))).otherwise("") for c in CREATORS]
    encoding = full("encoding", F.concat(*[_tag(c.replace("_", "-"), text(c)) for c in ENCODING]))
    other = [F.when(text(c).isNotNull(), F.concat(F.lit(f'<miscellaneous-field name="{c.replace("_", "-")}">'), text(c), F.lit("</miscellaneous-field>"))).otherwise("") for c in IMPORTS]
    identification = full("identification", F.concat(*creators, _tag("rights", text("rights")), encoding, _tag("source", text("source")), full("miscellaneous", F.concat(*other))))
    return F.concat(full("work", _tag("work-title", text("title"))), _tag("movement-title", text("movement_title")), identification)


def tempo_text(tempo: Column) -> Column:
    """A tempo mark: what is printed and what is played say the same."""
    return F.concat(F.lit('<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>'), tempo, F.lit('</per-minute></metronome></direction-type><sound tempo="'), tempo, F.lit('"/></direction>'))


def with_tempo(texts: DataFrame) -> DataFrame:
    """Documents (score_id, text) with the tempo of the column tempo, as a whole number. The first sound with a tempo gets it, and so does what the metronome
    of its direction prints; a document without one gets a direction at the beginning of its first measure, after its attributes. None above nought takes
    the sound away, and its direction if that holds sounds and metronomes only. Documents that can't be parsed stay as they are."""
    marks = once(X.nodes(texts, paths="/sound$|/part/measure(/attributes)?$|/direction").drop("value", "depth"))
    node = F.struct("nr", "last", "parent", "begins", "inner", "closes", "ends")
    first = lambda rows, name: rows.groupBy("score_id").agg(F.min_by(node, "nr").alias(name))
    sound = first(marks.filter("tag = 'sound' and attributes['tempo'] is not null"), "sound")
    measure = first(marks.filter("tag = 'measure' and path like '%/part/measure'"), "measure")
    within = lambda rows, of, key, name: first(rows.join(of.select("score_id", C(f"{of.columns[1]}.nr").alias("of"), C(f"{of.columns[1]}.last").alias("of_last"), C(f"{of.columns[1]}.parent").alias("of_parent")), "score_id").filter(key), name)
    direction = within(marks.filter("tag = 'direction'"), sound, "nr = of_parent", "direction")
    printed = within(marks.filter("path like '%/metronome/per-minute'"), direction, "nr > of and nr <= of_last", "printed")
    attributes = within(marks.filter("tag = 'attributes'"), measure, "parent = of", "attributes")
    only = X.tempo_only(direction.select("score_id", "direction.nr"), marks, sound.select("score_id", "sound.nr")).select("score_id", "only")
    rows = texts.select("score_id", "text", tempo_value(C("tempo").cast("double")).cast("string").alias("value"))
    for found in (sound, measure, direction, printed, attributes, only):
        rows = rows.join(found, "score_id", "left")
    splice = lambda begins, ends, put: F.struct(begins.alias("begins"), ends.alias("ends"), F.lit(0).alias("turn"), put.alias("put"))
    cut = lambda n: F.substr(C("text"), (C(f"{n}.begins") + 1).cast("int"), (C(f"{n}.inner") - C(f"{n}.begins")).cast("int"))
    wanted, there, closed = C("value").isNotNull(), C("sound").isNotNull(), lambda n: C(f"{n}.inner") == C(f"{n}.ends")
    gone = F.when(C("only"), C("direction")).otherwise(C("sound"))
    put = C("attributes.ends")
    edits = F.array(
        F.when(~wanted & there, splice(gone["begins"], gone["ends"], F.lit(""))),
        F.when(wanted & there, splice(C("sound.begins"), C("sound.inner"), F.regexp_replace(cut("sound"), r"""(\stempo\s*=\s*)("[^"]*"|'[^']*')""", F.concat(F.lit('$1"'), "value", F.lit('"'))))),
        F.when(wanted & there & C("printed").isNotNull(), F.when(closed("printed"), splice(C("printed.begins"), C("printed.ends"), F.concat(X.opened(cut("printed")), "value", F.lit("</per-minute>")))).otherwise(splice(C("printed.inner"), C("printed.closes"), C("value")))),
        F.when(wanted & ~there & C("measure").isNotNull(), F.when(closed("measure"), splice(C("measure.begins"), C("measure.ends"), F.concat(X.opened(cut("measure")), tempo_text(C("value")), F.lit("</measure>")))).otherwise(splice(F.coalesce(put, C("measure.inner")), F.coalesce(put, C("measure.inner")), tempo_text(C("value"))))),
    )
    return X.spliced(texts, rows.select("score_id", F.explode(edits).alias("e")).filter("e is not null").select("score_id", "e.*"))


#: The order in which the format wants elements to stand.
SCORE_ORDER = ("work", "movement-number", "movement-title", "identification", "defaults", "credit", "part-list", "part")
WORK_ORDER = ("work-number", "work-title", "opus")
IDENTIFICATION_ORDER = ("creator", "rights", "encoding", "source", "relation", "miscellaneous")


def with_metadata(texts: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents (score_id, text) with the fields of the updates (score_id and any of title, movement_title, composer, lyricist, arranger, rights, source) in
    place: a null keeps a field, a blank takes its element away, and a container that then holds no element. New elements and containers stand where the
    format's order has them. Documents that can't be parsed stay as they are."""
    head = X.nodes(texts, ("measure",)).filter("depth < 3").select("score_id", "nr", "parent", "depth", "tag", F.coalesce(C("attributes")["type"], F.lit("")).alias("kind"), "begins", "inner", "closes", "ends")
    node = F.struct("nr", "parent", "tag", "kind", "begins", "inner", "closes", "ends")
    level = lambda d: F.array_sort(F.collect_list(F.when(C("depth") == d, node)))
    rows = head.groupBy("score_id").agg(F.min_by(node, "nr").alias("root"), level(1).alias("top"), level(2).alias("inner"))
    given = {f: C(f"new_{f}") for f in FIELDS if f in updates.columns}
    rows = rows.join(updates.select("score_id", *[F.trim(C(f).cast("string")).alias(f"new_{f}") for f in given]), "score_id")
    first = lambda nodes, test: F.get(F.filter(nodes, test), F.lit(0))
    whole = lambda n: n["inner"] == n["ends"]  # an element that ends with its start tag
    rows = rows.withColumn("work", first("top", lambda n: n["tag"] == "work")).withColumn("identification", first("top", lambda n: n["tag"] == "identification"))
    children = lambda up: F.when(up.isNotNull(), F.filter("inner", lambda n: n["parent"] == up["nr"]))
    rows = rows.withColumns({"in_work": children(C("work")), "in_identification": children(C("identification"))})

    def place(children: Column, order: tuple, tag: str, end: Column) -> Column:
        """Where an element of a tag goes among its parent's children."""
        rank = F.array(*map(F.lit, order))
        return F.coalesce(first(children, lambda n: F.call_function("array_position", rank, n["tag"]) > order.index(tag) + 1)["begins"], end)

    splice = lambda begins, ends, put, turn=0: F.struct(begins.alias("begins"), ends.alias("ends"), F.lit(turn).alias("turn"), put.alias("put"))
    element = lambda tag, value, kind=None: F.concat(F.lit(f'<{tag} type="{kind}">' if kind else f"<{tag}>"), escaped(value), F.lit(f"</{tag}>"))

    def edit(field: str, children: Column, order: tuple, tag: str, end: Column, turn: int, kind: str | None = None) -> Column:
        """The splice of a field within a parent that is there."""
        found, value = first(children, lambda n: (n["tag"] == tag) & (n["kind"] == kind) if kind else n["tag"] == tag), given[field]
        new = place(children, order, tag, end)
        return F.when(value == "", F.when(found.isNotNull(), splice(found["begins"], found["ends"], F.lit("")))).when(value.isNotNull(), F.when(found.isNull(), splice(new, new, element(tag, value, kind), turn)).when(whole(found), splice(found["begins"], found["ends"], element(tag, value, kind), turn)).otherwise(splice(found["inner"], found["closes"], escaped(value), turn)))

    def boxed(box: str, order: tuple, fields: list[tuple]) -> list[Column]:
        """The splices of the fields of a container, which comes and goes with them. Its own place counts if it is empty already."""
        fields, children, turn = [f for f in fields if f[0] in given], C(f"in_{box}"), SCORE_ORDER.index(box)
        if not fields:
            return []
        inside = F.filter(F.array(*[edit(f, children, order, tag, C(box)["closes"], order.index(tag) * 10 + i, kind) for i, (f, tag, kind) in enumerate(fields)]), lambda x: x.isNotNull())
        here = lambda tag, kind: lambda n: (n["tag"] == tag) & (n["kind"] == kind) if kind else n["tag"] == tag
        leaving = sum((F.when((given[f] == "") & F.exists(children, here(tag, kind)), 1).otherwise(0) for f, tag, kind in fields), F.lit(0))
        coming = sum((F.when(given[f] != "", 1).otherwise(0) for f, _, _ in fields), F.lit(0))
        text = F.concat(F.lit(f"<{box}>"), *[F.when(given[f] != "", element(tag, given[f], kind)).otherwise("") for f, tag, kind in fields], F.lit(f"</{box}>"))
        at = place(C("top"), SCORE_ORDER, box, C("root.closes"))
        touched = F.coalesce(*[given[f] for f, _, _ in fields]).isNotNull()
        gone = touched & (coming == 0) & (F.size(children) - leaving <= 0)
        there = C(box).isNotNull()
        own = F.when(there & gone, splice(C(box)["begins"], C(box)["ends"], F.lit(""))).when(there & whole(C(box)) & (coming > 0), splice(C(box)["begins"], C(box)["ends"], text, turn)).when(~there & (coming > 0), splice(at, at, text, turn))
        none = F.array().cast("array<struct<begins:bigint,ends:bigint,turn:int,put:string>>")
        return [F.array(own), F.when(there & ~gone & ~whole(C(box)), inside).otherwise(none)]

    edits = boxed("work", WORK_ORDER, [("title", "work-title", None)])
    if "movement_title" in given:
        edits.append(F.array(edit("movement_title", C("top"), SCORE_ORDER, "movement-title", C("root.closes"), SCORE_ORDER.index("movement-title"))))
    edits += boxed("identification", IDENTIFICATION_ORDER, [*[(c, "creator", c) for c in CREATORS], ("rights", "rights", None), ("source", "source", None)])
    found = rows.select("score_id", F.explode(F.concat(*edits)).alias("e")).filter("e is not null").select("score_id", "e.*")
    return X.spliced(texts, found)


def metadata(texts: DataFrame) -> DataFrame:
    """All metadata of documents (score_id, text): titles, creators, rights, source, encoding (software is an array), the import fields, all other
    fields (misc: an array of name and value), and the first sound's tempo, if it is positive; empty values are null, and so is all of a document that
    can't be parsed. One pass over each document, of which a row for each of these elements goes on."""
    root, who = "/score-partwise", "/score-partwise/identification"
    rows = X.nodes(texts, paths=f"^{root}/(work|identification)/|^{root}/movement-title$|/sound$", every=True).filter("nr < 0 or tag <> 'sound' or attributes['tempo'] is not null").select("score_id", "nr", "tag", "path", "attributes", F.trim("value").alias("value"))
    first = lambda test, value="value": F.nullif(F.min_by(value, F.when(F.expr(test), C("nr"))), F.lit(""))
    every = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(F.expr(test), F.struct("nr", value.alias("v"))))), lambda x: x["v"])
    misc = f"{who}/miscellaneous/miscellaneous-field"
    found = rows.groupBy("score_id").agg(
        first(f"path = '{root}/work/work-title'").alias("title"), first(f"path = '{root}/movement-title'").alias("movement_title"), *[first(f"path = '{who}/creator' and attributes['type'] = '{c}'").alias(c) for c in CREATORS],
        first(f"path = '{who}/rights'").alias("rights"), first(f"path = '{who}/source'").alias("source"), every(f"path = '{who}/encoding/software'", C("value")).alias("software"),
        *[first(f"path = '{who}/encoding/{c.replace('_', '-')}'").alias(c) for c in ENCODING[1:]], *[first(f"path = '{misc}' and attributes['name'] = '{c.replace('_', '-')}'").alias(c) for c in IMPORTS],
        every(f"path = '{misc}'", F.struct(F.coalesce(C("attributes")["name"], F.lit("")).alias("name"), "value")).alias("misc"), F.min_by(F.expr("attributes['tempo']"), F.when(C("tag") == "sound", C("nr"))).try_cast("double").alias("tempo"), F.count_if(C("nr") < 0).alias("documents"))
    out = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), C("documents").cast("int")))).drop("documents", "_")
    none = {"software": "array<string>", "misc": "array<struct<name:string,value:string>>"}
    for c, kind in none.items():
        out = out.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return out.withColumn("tempo", F.when((C("tempo") > 0) & (C("tempo") < float("inf")), C("tempo")))


def upserted(known: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Metadata with the fields of the updates in their place: a null keeps a field, a blank clears it."""
    u = updates.select("score_id", *[C(f).alias(f"new_{f}") for f in fields])
    out = known.join(u, "score_id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(C(f"new_{f}").isNull(), C(f)).otherwise(F.nullif(F.trim(f"new_{f}"), F.lit("")))).drop(f"new_{f}")
    return out


def tempo_value(tempo: Column) -> Column:
    """A tempo as a whole number; null if it is none above nought."""
    return F.when((tempo > 0) & (tempo < float("inf")) & ~F.isnan(tempo), F.floor(tempo + 0.5))


#: How the ways of import are called.
METHODS = {"image": ("optical-music-recognition", "optical music recognition"), "midi": ("midi-conversion", "MIDI conversion"), "text": ("musicxml", "MusicXML import"), "mxl": ("compressed-musicxml", "compressed MusicXML import")}
SOFTWARE = "Stavework"


def stamped(known: DataFrame, imports: DataFrame) -> DataFrame:
    """Metadata with how, from what and when a document came in (imports: score_id, kind, path, date); doing it again changes nothing. An
    import without a path keeps the source file that was known."""
    name, label = (F.element_at(F.create_map(*[F.lit(x) for k, v in METHODS.items() for x in (k, v[i])]), C("kind")) for i in (0, 1))
    path = F.nullif(F.trim("path"), F.lit(""))
    text = F.when(path.isNull(), F.concat(F.lit("Imported via "), label)).otherwise(F.concat(F.lit('Imported from "'), path, F.lit('" via '), label))
    fields = {"software": F.lit(SOFTWARE), "encoding_date": C("date").cast("string"), "encoding_description": text, "source": text, "import_method": name, "import_source_file": path, "import_date": C("date").cast("string")}
    return upserted(known, imports.select("score_id", *[c.alias(f) for f, c in fields.items()]), list(fields))


def blank_scores(requests: DataFrame, beats: int = 4, beat_type: int = 4, fifths: int = 0, sign: str = "G", line: int = 2, divisions: int = 4) -> DataFrame:
    """Measures of new scores (score_id, n): a whole rest each; the first declares divisions, key, meter and clef. Columns of the requests
    with these names go before the given values."""
    given = {"beats": beats, "beat_type": beat_type, "fifths": fifths, "sign": sign, "line": line}
    value = lambda c: F.coalesce(C(c), F.lit(given[c])) if c in requests.columns else F.lit(given[c])
    rows = requests.select("score_id", "n", *[value(c).alias(c) for c in given]).select("*", F.explode(F.sequence(F.lit(0), C("n") - 1)).alias("measure_idx"))
    first = C("measure_idx") == 0
    clef = F.when(first, F.array(F.struct(F.lit(1).alias("staff"), "sign", "line")))
    return rows.select("score_id", F.lit(0).alias("part_idx"), "measure_idx", F.floor(divisions * C("beats") * 4 / C("beat_type")).cast("int").alias("rest"), F.when(first, divisions).alias("divisions"), F.when(first, "major").alias("mode"), *[F.when(first, C(c)).alias(c) for c in ("fifths", "beats", "beat_type")], clef.alias("clefs"))


def blank_elements(measures: DataFrame) -> DataFrame:
    """The whole rests of blank measures, as elements."""
    none = {"is_chord": False, "is_grace": False, "dot": False, "slash": False, "tie_start": False, "tie_stop": False}
    return measures.select(*MEASURE, F.lit(0).alias("elem_idx"), F.lit("note").alias("tag"), F.lit(True).alias("is_rest"), F.lit(True).alias("full_measure"), C("rest").alias("duration"), F.lit(1).alias("staff"), F.lit(1).alias("voice"), *[F.lit(None).cast("string").alias(c) for c in ("step", "alter", "octave", "type")], *[F.lit(v).alias(k) for k, v in none.items()])
