"""Documents as rows of elements: places and nesting, tempo and metadata edits, whole folders, and documents fit for other readers."""

import random
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavework.sources import scores as S
from stavework.sources import structure as X

BLANK = '<?xml version="1.0" encoding="UTF-8"?>\n<score-partwise version="4.0"><part-list><score-part id="P1"><part-name>Müsik 🎵</part-name></score-part></part-list><part id="P1"><measure number="1"><attributes><divisions>4</divisions></attributes><note><rest/></note></measure></part></score-partwise>'


def plain(x):
    """An element of another parser as (tag, attributes, own text, children)."""
    return x.tag, dict(x.attrib), x.text or "", [plain(c) for c in x]


def test_places_and_nesting():
    """Random trees: start tags, contents and ends are where they are said to be, and nesting is as another parser has it."""
    rng = random.Random(1)

    def tree(depth):
        tag, attribute = rng.choice("abc"), rng.choice(["", ' x="1"', " y='>\"&lt;'", ' z = "ü🎵" '])
        inner = "".join(rng.choice(["t", "é", "&amp;", " ", "<!-- <b> -->", ""]) + tree(depth + 1) for _ in range(rng.randrange(4) if depth < 4 else 0))
        return f"<{tag}{attribute}/>" if not inner and rng.random() < 0.5 else f"<{tag}{attribute}>{inner}</{tag} >"

    for _ in range(50):
        text = "<!-- ü --><r>" + tree(0) + "</r>"
        rows = X.node_rows(text)
        others = list(ElementTree.fromstring(text).iter())
        assert [r["tag"] for r in rows] == [o.tag for o in others] and [r["attributes"] for r in rows] == [dict(o.attrib) for o in others]
        for r, o in zip(rows, others):
            assert plain(ElementTree.fromstring(text[r["begins"] : r["ends"]])) == plain(o) and r["last"] - r["nr"] + 1 == len(list(o.iter()))
            assert text[r["begins"]] == "<" and text[r["inner"] - 1] == ">" and (r["inner"] == r["ends"] or text[r["closes"] : r["closes"] + 2] == "</")
            assert r["parent"] is None or rows[r["parent"]]["nr"] < r["nr"] <= rows[r["parent"]]["last"]
    assert X.node_rows("<a><b></a>") == X.node_rows("") == [] and [r["tag"] for r in X.node_rows(BLANK, frozenset({"part"}))] == ["score-partwise", "part-list", "score-part", "part-name"]


def tempo(spark, text, value):
    return S.with_tempo(spark.createDataFrame([(1, text, value)], "score_id long, text string, tempo double")).first().text


def scored(inner, first=""):
    return f"<score-partwise><part><measure>{first}{inner}<note/></measure></part></score-partwise>"


METRONOME = "<direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>80</per-minute></metronome></direction-type>"
WORDS = "<direction-type><words>dolce</words></direction-type>"


@pytest.mark.parametrize("inner,value,want", [
    # what stands beside the tempo stays
    (f'<direction>{WORDS}<sound tempo="80"/></direction>', None, f"<direction>{WORDS}</direction>"),
    (f'<direction>{METRONOME}<sound tempo="80"/></direction>', None, ""),
    (f'<direction>{METRONOME}<sound tempo="80"/><sound dynamics="1"/></direction>', 0.0, ""),
    (f'<direction><direction-type/><sound tempo="80"/></direction>', None, "<direction><direction-type/></direction>"),
    # only the first mark changes, however many are alike
    (f'<direction>{METRONOME}<sound tempo="80"/></direction>' * 2, 99.5, f'<direction>{METRONOME.replace("80", "100")}<sound tempo="100"/></direction><direction>{METRONOME}<sound tempo="80"/></direction>'),
    # a sound outside a direction, and single quotes
    ("<sound dynamics='5' tempo = '80'/>", 60.0, "<sound dynamics='5' tempo = \"60\"/>"),
    ("<sound tempo='80'/>", None, ""),
    # a mark that is printed only gets no second one, as it is no tempo yet
    (f"<direction>{WORDS}</direction>", None, f"<direction>{WORDS}</direction>"),
    ('<direction><direction-type><metronome><per-minute/></metronome></direction-type><sound tempo="1"/></direction>', 7.0, '<direction><direction-type><metronome><per-minute>7</per-minute></metronome></direction-type><sound tempo="7"/></direction>'),
])
def test_tempo_edits_touch_one_mark(spark, inner, value, want):
    assert tempo(spark, scored(inner), value) == scored(want)


def test_a_new_tempo_stands_after_the_attributes(spark):
    mark = '<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>132</per-minute></metronome></direction-type><sound tempo="132"/></direction>'
    assert tempo(spark, scored("", "<attributes/>"), 132.0) == scored(mark, "<attributes/>") and tempo(spark, scored(""), 132.0) == scored(mark)
    assert tempo(spark, '<s><part><measure number="1"/></part></s>', 132.0) == f'<s><part><measure number="1">{mark}</measure></part></s>'
    for same in ("<s/>", "<broken", ""):
        assert tempo(spark, same, 132.0) == same
    assert tempo(spark, tempo(spark, BLANK, 132.0), None) == BLANK


def edited(spark, text, **fields):
    updates = spark.createDataFrame([(1, *fields.values())], "score_id long, " + ", ".join(f"{f} string" for f in fields))
    return S.with_metadata(spark.createDataFrame([(1, text), (2, text)], "score_id long, text string"), updates).filter("score_id = 1").first().text


def read(spark, text):
    return S.metadata(spark.createDataFrame([(1, text)], "score_id long, text string")).first()


def tags(text, path="."):
    return [(c.tag, c.get("type")) for c in ElementTree.fromstring(text.encode()).find(path)]


FULL = {"title": "Sonata", "movement_title": "Allegro", "composer": "Mozart", "lyricist": "Da Ponte", "arranger": "Liszt", "rights": "© 2026", "source": "First & <only>"}


def test_metadata_of_a_blank_score(spark):
    r = read(spark, BLANK)
    assert [r[f] for f in FULL] == [None] * 7 and r.software == [] and r.misc == [] and r.tempo is None


def test_metadata_written_in_order_and_read(spark):
    text = edited(spark, BLANK, **FULL)
    assert {f: read(spark, text)[f] for f in FULL} == FULL
    assert [t for t, _ in tags(text)] == ["work", "movement-title", "identification", "part-list", "part"]
    assert tags(text, "identification") == [("creator", "composer"), ("creator", "lyricist"), ("creator", "arranger"), ("rights", None), ("source", None)]


def test_clearing_prunes_what_is_empty(spark):
    text = edited(spark, BLANK, **FULL)
    assert edited(spark, text, **dict.fromkeys(FULL, " ")) == BLANK
    kept = text.replace("<source>", "<encoding><software>s</software></encoding><source>")
    left = edited(spark, kept, **dict.fromkeys(FULL, ""))
    assert [t for t, _ in tags(left)] == ["identification", "part-list", "part"] and tags(left, "identification") == [("encoding", None)]


def test_fields_in_place(spark):
    text = edited(spark, edited(spark, BLANK, composer="First"), composer="Second", rights="R")
    assert tags(text, "identification") == [("creator", "composer"), ("rights", None)] and read(spark, text).composer == "Second"
    # a null keeps a field; a new one goes before what the format has after it
    text = BLANK.replace("<part-list>", "<work><work-number>3</work-number><opus/></work><identification><creator type='poet'>P</creator><encoding/></identification><part-list>", 1)
    text = edited(spark, text, title="T", composer="C", rights=None, source="S")
    assert [t for t, _ in tags(text, "work")] == ["work-number", "work-title", "opus"]
    assert tags(text, "identification") == [("creator", "poet"), ("creator", "composer"), ("encoding", None), ("source", None)]
    assert tags(edited(spark, BLANK.replace("<part-list>", "<work/><part-list>", 1), title="T"), "work") == [("work-title", None)]


def test_folders_of_scores(spark, tmp_path):
    """Written by score and read again: plain, compressed, broken, no text, and files that are no scores."""
    from test_golden import XML

    texts = spark.createDataFrame([(1, BLANK), (2, XML)], "score_id long, text string")
    S.write_scores(texts, str(tmp_path / "scores"))
    for r in S.packed(texts.select(F.concat(F.lit("s"), "score_id").alias("path"), "text")).collect():
        (tmp_path / "scores" / f"{r.path}.mxl").write_bytes(r.content)
    (tmp_path / "scores" / "deep").mkdir()
    for name, content in (("broken.xml", b"<score-partwise><part>"), ("bytes.musicxml", b"<a>\xff\xfe</a>"), ("bad.mxl", b"PK"), ("scan.pdf", b"%PDF")):
        (tmp_path / "scores" / "deep" / name).write_bytes(content)
    rows = S.read_scores(spark, str(tmp_path / "scores")).cache()
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    assert {r.name for r in rows.filter("error is not null").select(name.alias("name")).collect()} == {"broken.xml", "bytes.musicxml", "bad.mxl"}
    good = rows.filter("error is null and tag is not null").groupBy("path").count().collect()
    assert sorted(r["count"] for r in good) == [1, 1, 2, 2]


def test_engraved_documents(spark):
    """Part list, beams, printed accidentals, and curves of ties."""
    from test_golden import ELEMENT, MEASURE

    note = lambda i, kind, alter, a=False, b=False: (1, 0, 0, i, "note", False, False, False, 2, 1, 1, "F", alter, 4, kind, False, False, a, b)
    e = spark.createDataFrame([note(0, "eighth", 1, True), note(1, "eighth", 1, False, True), note(2, "quarter", 0)], ELEMENT)
    m = spark.createDataFrame([(1, 0, 0, 4, 0, 4, 4, False, None)], MEASURE)
    text = S.exported(S.engraved(e, m), m, spark.createDataFrame([(1, 90)], "score_id long, tempo int"), part_list=True).first().text
    root = ElementTree.fromstring(text)
    notes = root.findall("part/measure/note")
    assert [c.tag for c in root] == ["part-list", "part"] and root.find("part-list/score-part").get("id") == root.find("part").get("id")
    assert [n.findtext("accidental") for n in notes] == ["sharp", None, "natural"] and [n.findtext("beam") for n in notes] == ["begin", "end", None]
    assert [[t.get("type") for t in n.iter("tied")] for n in notes] == [["start"], ["stop"], []]
    assert [c.tag for c in root.find("part/measure")] == ["attributes", "direction", "note", "note", "note"]


def test_collections_of_scores(spark, tmp_path):
    """Many documents a file, whatever they hold: lines, a broken one, none; their rows are those of the documents."""
    from test_golden import XML

    texts = [("a/1.xml", BLANK), ("b/2.xml", XML), ("broken.xml", "<s><part>"), ("none.xml", None), ("lines.xml", "<s>\n\t<part>\r\n<measure/></part></s>")]
    S.write_collection(spark.createDataFrame(texts, "path string, text string").coalesce(1), str(tmp_path / "all"))
    assert len(list((tmp_path / "all").glob("part-*"))) == 1
    rows = S.read_collection(spark, str(tmp_path / "all")).cache()
    assert {r.path for r in rows.filter("error is not null").collect()} == {"broken.xml", "none.xml"}
    one = S.parsed(spark.createDataFrame([texts[1]], "path string, text string").withColumn("score_id", F.lit(0)))
    assert rows.filter("path = 'b/2.xml'").drop("path", "score_id").exceptAll(one.drop("score_id")).count() == 0 and rows.filter("path = 'b/2.xml'").count() == one.count()
    assert rows.filter("path = 'lines.xml' and tag is null").count() == 1


def test_only_wanted_elements_are_rows(spark):
    """Only wanted elements become rows; a document without any keeps its place."""
    texts = spark.createDataFrame([(i, scored("<note/>" * 3) if i else "<broken") for i in range(500)], "score_id long, text string").coalesce(1)
    assert S.parsed(texts).count() == 1 + 499 * 5
    assert [r["tag"] for r in X.node_rows(scored("<sound/>"), wanted=lambda path: path.endswith("/sound"))] == ["sound"]
    meta = S.metadata(texts)
    assert meta.count() == 500 and meta.select("score_id").distinct().count() == 500


def test_elements_without_a_measure_are_left_out(spark):
    from test_golden import ELEMENT, MEASURE

    e = spark.createDataFrame([(1, 0, k, 0, "forward", False, False, False, 2, 1, 1, None, None, None, None, False, False, False, False) for k in (0, 5)], ELEMENT)
    text = S.exported(e, spark.createDataFrame([(1, 0, 0, None, None, None, None, False, None), (2, 0, 0, None, None, None, None, False, None)], MEASURE)).orderBy("score_id").collect()
    assert [(r.score_id, r.text.count("<forward>"), r.text.count("<measure ")) for r in text] == [(1, 1, 1), (2, 0, 1)]


def test_repeated_and_nested_children(spark):
    """Of children of one tag the first counts, of pitches whichever has the value, and ties at any depth."""
    note = "<note><duration> +3 </duration><duration>9</duration><pitch><octave>5</octave><octave>1</octave></pitch><pitch><step>G</step></pitch><x><tie type='stop'/></x><tie type='start'/></note>"
    r = S.parsed(spark.createDataFrame([(1, scored(note))], "score_id long, text string")).filter("elem_idx = 0").first()
    assert (r.duration, r.step, r.octave, r.alter, r.tie_start, r.tie_stop, r.note_duration) == (3, "G", 5, 0, True, True, 3)


def test_few_files_are_packed_at_once(spark):
    """Files are packed and unpacked in small pieces, however many a batch comes in with; what is no archive is an error."""
    n = 500
    texts = spark.createDataFrame([(f"{i}.mxl", BLANK + " " * i) for i in range(n)], "path string, text string").coalesce(1)
    packed = S.packed(texts).localCheckpoint()
    batch = pa.RecordBatch.from_pydict({"path": list(range(n))})
    pieces = list(S._parts([batch, batch]))
    assert max(p.num_rows for p in pieces) == S.FILES and [x for p in pieces for x in p.column(0).to_pylist()] == [*range(n)] * 2
    assert S.unpacked(packed).select("path", "text").exceptAll(texts).count() == 0
    bad = S.unpacked(spark.createDataFrame([("a", b"PK"), ("b", None)], "path string, content binary")).collect()
    assert [(r.path, r.text, r.error) for r in bad] == [("a", None, "BadZipFile"), ("b", None, "TypeError")]


def test_export_gathers_a_score_once(spark):
    """Two parts, an element whose measure is not there, a measure that is given twice, and a plan with one exchange by score and one aggregation."""
    m = spark.createDataFrame([(1, 0, 0, 4, False, None), (1, 0, 1, None, True, 2), (1, 0, 1, 3, True, None), (1, 1, 0, None, False, None)], "score_id long, part_idx int, measure_idx int, divisions int, repeat_start boolean, repeat_times int").withColumns({"fifths": F.lit(None).cast("int"), "beats": F.lit(None).cast("int"), "beat_type": F.lit(None).cast("int")})
    e = spark.createDataFrame([(1, p, k, at, "backup", d) for p, k, at, d in ((0, 0, 1, 2), (0, 0, 0, 1), (0, 7, 0, 9), (2, 0, 0, 9), (1, 0, 0, 5))], "score_id long, part_idx int, measure_idx int, elem_idx int, tag string, duration int")
    e = e.withColumns({**{c: F.lit(False) for c in ("is_chord", "is_grace", "is_rest", "dot", "slash", "tie_start", "tie_stop")}, **{c: F.lit(None).cast("string") for c in ("step", "alter", "octave", "type", "voice", "staff")}})
    texts = S.exported(e, m, part_list=True)
    b = lambda n: f"<backup><duration>{n}</duration></backup>"
    again = '<measure number="2"><attributes><divisions>3</divisions></attributes><barline location="left"><repeat direction="forward"/></barline>'
    want = f'<part id="P1"><measure number="1"><attributes><divisions>4</divisions></attributes>{b(1)}{b(2)}</measure>{again}'
    text = texts.first().text
    assert text.startswith('<score-partwise version="4.0"><part-list><score-part id="P1"><part-name>Part 1</part-name></score-part><score-part id="P2"><part-name>Part 2</part-name></score-part></part-list>')
    assert want in text and text.endswith(f'</measure></part><part id="P2"><measure number="1">{b(5)}</measure></part></score-partwise>') and b(9) not in text and text.count('<measure number="2">') == 1
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("RepartitionByExpression") == 1


def test_measures_alone(spark):
    """Without elements only the rows of measures and errors come; they are the same."""
    texts = spark.createDataFrame([(1, BLANK), (2, "<a")], "score_id long, text string")
    every, some = S.parsed(texts), S.parsed(texts, elements=False)
    assert every.filter("tag is null").exceptAll(some).isEmpty() and some.exceptAll(every.filter("tag is null")).isEmpty() and some.count() > 1


def test_tagged_elements_are_those_of_the_reader_with_places():
    """Own text, namespaces, comments, entities and what can't be parsed, as node_rows has them."""
    wanted = frozenset(("a", "b", "x:a"))
    for text in ("<r><a>1<b>2</b>3<!-- c -->4</a><c><b/></c></r>", "<a>é🎵<?p q?>t</a>", '<r xmlns="u"><a>1</a></r>', '<r xmlns:x="u"><x:a>1</x:a></r>', "<r><x:a>1</x:a></r>", '<!DOCTYPE r [<!ENTITY q "zz">]><r><a>&q;</a></r>', '<!DOCTYPE r SYSTEM "s"><r><a>&q;1</a></r>', "<r><a>", ""):
        rows = [r for r in X.node_rows(text) if r["tag"] in wanted]
        assert X.tagged_values(text, wanted) == ([r["tag"] for r in rows], [r["value"] for r in rows]), text


def test_documents_are_written_in_as_many_tasks_as_shuffles_have(spark):
    """Few bytes of measures and elements are much work, so their tasks must not be merged by bytes; scores that are not plain are written as before."""
    e = spark.sql("select 1L score_id, 0 part_idx, 0 measure_idx, 0 elem_idx, 'note' tag, false is_chord, false is_grace, true is_rest, 1 duration, 1 staff, 1 voice, 'C' step, 0 alter, 4 octave, 'half' type, false dot, false tie_start, false tie_stop, false slash")
    e = e.unionByName(e.withColumn("measure_idx", F.lit(9))).unionByName(e.withColumn("score_id", F.lit(2).cast("long"))).unionByName(e.withColumn("score_id", F.lit(3).cast("long")).withColumn("part_idx", F.lit(1)))
    m = spark.sql("select score_id, part_idx, 0 measure_idx, divisions, null fifths, null beats, null beat_type, part_idx = 1 repeat_start, null repeat_times from values (1L, 0, 1), (2L, 0, 1), (2L, 0, 2), (3L, 0, 1), (3L, 1, null) as t (score_id, part_idx, divisions)")
    texts = S.exported(e, m, part_list=True)
    note = "<note><rest/><duration>1</duration><voice>1</voice><type>half</type><staff>1</staff></note>"
    head = lambda d: f'<measure number="1">{f"<attributes><divisions>{d}</divisions></attributes>" if d else ""}'
    one = lambda p: f'<score-part id="P{p}"><part-name>Part {p}</part-name></score-part>'
    whole = lambda parts, inner: f'<score-partwise version="4.0"><part-list>{"".join(map(one, parts))}</part-list>{inner}</score-partwise>'
    repeat = '<barline location="left"><repeat direction="forward"/></barline>'
    assert {r.score_id: r.text for r in texts.collect()} == {
        1: whole([1], f'<part id="P1">{head(1)}{note}</measure></part>'), 2: whole([1], f'<part id="P1">{head(2)}{note}</measure></part>'),
        3: whole([1, 2], f'<part id="P1">{head(1)}</measure></part><part id="P2">{head(0)}{repeat}{note}</measure></part>')}
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
