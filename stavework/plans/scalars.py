"""Queries of the scalar functions: pitch, rhythm and token columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.functions import pitch as P
from stavework.functions import rhythm as R
from stavework.functions import tokens as T
from stavework.sources import adapters as A

from .base import Queries

Q = Queries()
KEY = "score_id:l measure_idx:l elem_idx:l"
C = F.col
DIA = "(strpos('CDEFGAB', step) - 1 + 7 * octave)"
SEMI = "(2 * (strpos('CDEFGAB', step) - 1) - CASE WHEN strpos('CDEFGAB', step) > 3 THEN 1 ELSE 0 END)"
K = "score_id, measure_idx, elem_idx"
STD = "list_filter([4.0 * dv, 3.0 * dv, 2.0 * dv, 1.5 * dv, 1.0 * dv, 0.75 * dv, 0.5 * dv, 0.25 * dv], lambda x: x = floor(x))"


def on_notes(name: str, schema: str, columns, sql: str, source: str = "note_elements") -> None:
    """A query of columns over the notes; columns() gives them by name."""
    Q.add(name, f"{KEY} {schema}", lambda spark, d: A.note_elements(spark, d).filter("tag = 'note'").select("score_id", "measure_idx", "elem_idx", *[c.alias(n) for n, c in columns().items()]), f"SELECT {K}, {sql} FROM {source} WHERE tag = 'note'")


def on_midi(name: str, schema: str, columns, sql: str, source: str = "midi_events") -> None:
    Q.add(name, f"track:l seq:l {schema}", lambda spark, d: A.midi_events(spark, d).select("track", "seq", *[c.alias(n) for n, c in columns().items()]), f"SELECT track, seq, {sql} FROM midi_events")


def on_tokens(name: str, schema: str, columns, sql: str, where: str = "true") -> None:
    Q.add(name, f"staff_idx:l pos:l {schema}", lambda spark, d: A.omr_tokens(spark, d).filter(where).select("staff_idx", "pos", *[c.alias(n) for n, c in columns().items()]), f"SELECT staff_idx, pos, {sql} FROM omr_tokens WHERE {where}")


def key_sql(step: str, fifths: str) -> str:
    return f"CASE WHEN {fifths} > 0 AND strpos('FCGDAEB', {step}) <= {fifths} THEN 1 WHEN {fifths} < 0 AND strpos('BEADGCF', {step}) <= -({fifths}) THEN -1 ELSE 0 END"


FIFTHS = "(mark % 15 - 7)"
fifths = lambda: (C("mark") % 15 - 7).cast("int")

on_notes("b1_diatonic_index", "diatonic:l", lambda: {"diatonic": P.diatonic_index(C("step"), C("octave"))}, f"{DIA} AS diatonic")
on_notes("b2_pitch_from_diatonic", "step2:s octave2:l", lambda: dict(zip(("step2", "octave2"), P.pitch_from_diatonic(P.diatonic_index(C("step"), C("octave")) - 30))),
         f"substr('CDEFGAB', CAST((({DIA} - 30) % 7 + 7) % 7 + 1 AS INT), 1) AS step2, CAST(floor(({DIA} - 30) / 7.0) AS BIGINT) AS octave2")
on_midi("b3_midi_to_pitch", "step:s sharp:l octave:l", lambda: dict(zip(("step", "sharp", "octave"), P.pitch_from_midi(C("note")))), "substr('CCDDEFFGGAAB', note % 12 + 1, 1) AS step, CAST(substr('010100101010', note % 12 + 1, 1) AS INT) AS sharp, note // 12 - 1 AS octave")
on_notes("b4_pitch_to_midi", "midi:l chroma:l cents:l", lambda: {"midi": P.midi_number(C("step"), C("alter"), C("octave")), "chroma": P.chroma(C("step"), C("alter"), C("octave")), "cents": R.half_up(100 * P.frequency(C("step"), C("alter"), C("octave")))},
         f"{SEMI} + 12 * octave + alter_ + 12 AS midi, {SEMI} + 12 * octave + alter_ AS chroma, floor(100 * (440 * pow(2.0::DOUBLE, ({SEMI} + 12 * octave + alter_ + 12 - 69) / 12.0::DOUBLE)) + 0.5) AS cents")
on_notes("b5_key_alteration", "key_alter:l", lambda: {"key_alter": P.key_alter(C("step"), fifths())}, f"{key_sql('step', FIFTHS)} AS key_alter")
on_notes("b6_step_in_key", "step2:s alter2:l octave2:l", lambda: dict(zip(("step2", "alter2", "octave2"), P.moved(C("step"), C("octave"), (C("mark") % 9 - 4).cast("int"), fifths()))),
         f"step2, {key_sql('step2', FIFTHS)} AS alter2, octave2", f"(SELECT *, substr('CDEFGAB', CAST((({DIA} + mark % 9 - 4) % 7 + 7) % 7 + 1 AS INT), 1) AS step2, floor(({DIA} + mark % 9 - 4) / 7.0) AS octave2 FROM note_elements)")
on_notes("b7_octave_shift", "octave2:l", lambda: {"octave2": C("octave") + (C("mark") % 5 - 2)}, "octave + mark % 5 - 2 AS octave2")
on_notes("b8_pitch_text", "pitch:s", lambda: {"pitch": P.pitch_text(C("step"), C("alter"), C("octave"))}, "step || repeat('#', greatest(alter_, 0)) || repeat('b', greatest(-alter_, 0)) || octave AS pitch")
NAMES = ("whole", "half", "quarter", "eighth", "sixteenth", "thirty_second")
name_of = lambda: F.element_at(F.array(*[F.lit(n) for n in NAMES]), (C("k") % 6 + 1).cast("int"))
on_midi("b9_note_divisions", "divisions:l", lambda: {"divisions": R.note_divisions(name_of(), C("k") % 2 == 0)}, "CASE WHEN k % 2 = 0 THEN floor([16, 8, 4, 2, 1, 1][k % 6 + 1] * 1.5 + 0.5) ELSE [16, 8, 4, 2, 1, 1][k % 6 + 1] END AS divisions")
on_midi("b10_beam_count", "beams:l", lambda: {"beams": R.by_name(name_of(), R.BEAMS)}, "[0, 0, 0, 1, 2, 3][k % 6 + 1] AS beams")
on_midi("b11_grid_snap", "start_tick:l end_tick:l", lambda: dict(zip(("start_tick", "end_tick"), R.snapped(C("tick"), C("tick") + C("k"), 48))), "floor(tick / 48.0 + 0.5) * 48 AS start_tick, greatest(floor((tick + k) / 48.0 + 0.5) * 48, floor(tick / 48.0 + 0.5) * 48 + 48) AS end_tick")
DV = "(k % 5 + 1)"
dv = lambda: (C("k") % 5 + 1).cast("double")
on_midi("b12_standard_durations", "spans:s", lambda: {"spans": F.array_join(F.transform(R.standard_durations(dv()), lambda x: x.cast("string")), ",")}, f"array_to_string(list_transform({STD.replace('dv', DV)}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS spans")
on_midi("b13_largest_fit", "fit:l", lambda: {"fit": R.largest_fit(C("velocity") % 23, dv())}, f"coalesce(list_filter({STD.replace('dv', DV)}, lambda x: x <= velocity % 23)[1], 1) AS fit")
on_midi("b15_nearest_standard", "nearest:l", lambda: {"nearest": R.nearest_standard(C("velocity") % 23, dv())}, f"-list_min(list_transform({STD.replace('dv', DV)}, lambda x: {{'o': abs(x - velocity % 23), 'd': -x}})).d AS nearest")
on_midi("b16_type_and_dot", "name:s dot:b", lambda: dict(zip(("name", "dot"), R.type_and_dot((C("velocity") % 23 / 2), dv()))),
        f"CASE velocity % 23 / 2.0 / {DV} WHEN 4 THEN 'whole' WHEN 3 THEN 'half' WHEN 2 THEN 'half' WHEN 0.75 THEN 'eighth' WHEN 0.5 THEN 'eighth' WHEN 0.25 THEN '16th' ELSE 'quarter' END AS name, velocity % 23 / 2.0 / {DV} IN (3, 1.5, 0.75) AS dot")
PARSED = """CASE WHEN starts_with(rhythm, 'rest_') AND ends_with(rhythm, 'm') THEN 'whole' WHEN ends_with(rhythm, '..') THEN NULL ELSE
  CASE regexp_replace(replace(substr(rhythm, 6), 'G', ''), '\\.$', '') WHEN '0' THEN 'whole' WHEN '1' THEN 'whole' WHEN '2' THEN 'half' WHEN '4' THEN 'quarter' WHEN '8' THEN 'eighth' WHEN '16' THEN 'sixteenth' WHEN '32' THEN 'thirty_second' END END AS duration"""
on_tokens("b17_note_token", "is_rest:b duration:s dotted:b grace:b", lambda: T.note_token(C("rhythm")), f"starts_with(rhythm, 'rest_') AS is_rest, {PARSED}, ends_with(rhythm, '.') AS dotted, contains(rhythm, 'G') AS grace", "rhythm LIKE 'note~_%' ESCAPE '~' OR rhythm LIKE 'rest~_%' ESCAPE '~'")
on_tokens("b18_attribute_tokens", "sign:s line:l key_fifths:l time_number:l", lambda: dict(zip(("sign", "line"), T.clef_token(C("rhythm")))) | {"key_fifths": T.key_token(C("rhythm")), "time_number": T.time_token(C("rhythm"))},
          "CASE WHEN starts_with(rhythm, 'clef_') THEN substr(rhythm, 6, 1) END AS sign, CASE WHEN starts_with(rhythm, 'clef_') THEN CAST(substr(rhythm, 7) AS INT) END AS line, TRY_CAST(regexp_extract(rhythm, '^keySignature_(-?[0-9]+)$', 1) AS INT) AS key_fifths, TRY_CAST(regexp_extract(rhythm, '^timeSignature/([0-9]+)$', 1) AS INT) AS time_number")
Q.add("b14_decompose", "track:l seq:l idx:l units:l left_whole:b", lambda spark, d: A.midi_events(spark, d).select("track", "seq", F.lit(True).alias("left_whole"), F.posexplode(R.decomposed(C("velocity") % 37, dv(), True)).alias("idx", "units")).unionByName(
    A.midi_events(spark, d).select("track", "seq", F.lit(False).alias("left_whole"), F.posexplode(R.decomposed(C("velocity") % 37, dv(), False)).alias("idx", "units"))),
    f"""WITH RECURSIVE r AS (SELECT track, seq, k, -1 AS idx, CAST(velocity % 37 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS units FROM midi_events
    UNION ALL SELECT track, seq, k, idx + 1, rest - u, u FROM (SELECT *, CAST(list_filter({STD.replace('dv', DV)}, lambda x: x <= rest)[1] AS BIGINT) AS u FROM r WHERE rest > 0) WHERE u IS NOT NULL),
    l AS (SELECT track, seq, max(idx) + 1 AS idx, min(rest) AS units FROM r GROUP BY ALL HAVING min(rest) > 0)
    SELECT track, seq, idx, units, b AS left_whole FROM r, (VALUES (true), (false)) AS v(b) WHERE idx >= 0 UNION ALL SELECT track, seq, idx, units, true FROM l""")  # fmt: skip
Q.add("b19_token_text", "staff_idx:l pos:l text:s", lambda spark, d: _token_text(spark, d), "SELECT staff_idx, pos, coalesce(t, '?' || id) AS text FROM (SELECT staff_idx, pos, k AS id FROM omr_tokens) LEFT JOIN (SELECT k AS id, min(rhythm) AS t FROM omr_tokens WHERE k % 3 <> 0 GROUP BY k) USING (id)")


def _token_text(spark, d):
    """Ids with their vocabulary's text; here the vocabulary is the least token of each id, and some ids have none."""
    tokens = A.omr_tokens(spark, d)
    vocabulary = tokens.filter("k % 3 <> 0").groupBy("k").agg(F.min("rhythm").alias("t"))
    return tokens.join(vocabulary, "k", "left").select("staff_idx", "pos", F.coalesce("t", F.concat(F.lit("?"), C("k").cast("string"))).alias("text"))


Q.add("b20_editable_scores", "score_id:l", lambda spark, d: A.omr_tokens(spark, d).groupBy(C("page_id").alias("score_id")).agg(F.countDistinct("staff_idx").alias("parts")).filter("parts = 15 or parts = 1").select("score_id"), "SELECT page_id AS score_id FROM omr_tokens GROUP BY page_id HAVING count(DISTINCT staff_idx) IN (1, 15)")
Q.add("b21_tempo_only", "staff_idx:l tempo_only:b", lambda spark, d: A.omr_tokens(spark, d).withColumn("child", F.when(C("k") < 90, "metronome").otherwise("words")).groupBy("staff_idx").agg(F.bool_and(C("child") == "metronome").alias("tempo_only")), "SELECT staff_idx, bool_and(k < 90) AS tempo_only FROM omr_tokens GROUP BY staff_idx")
Q.add("b22_measure_length", "score_id:l measure_idx:l length:d", lambda spark, d: A.measures(spark, d).select("score_id", "measure_idx", R.measure_length(F.coalesce("beats", F.lit(4)), F.coalesce("beat_type", F.lit(4)), F.coalesce("divisions", F.lit(4))).alias("length")), "SELECT score_id, measure_idx, coalesce(divisions, 4) * coalesce(beats, 4) * (4.0::DOUBLE / coalesce(beat_type, 4)) AS length FROM measures")
on_notes("b24_letter_near_staff", "near_octave:l", lambda: {"near_octave": P.near_staff_octave(C("step"), C("staff") == 2)},
         "list_min(list_transform([-1, 0, 1], lambda x: {'d': abs((floor((CASE WHEN staff = 2 THEN 22 ELSE 34 END - strpos('CDEFGAB', step) + 1) / 7.0 + 0.5) + x) * 7 + strpos('CDEFGAB', step) - 1 - CASE WHEN staff = 2 THEN 22 ELSE 34 END), 'o': floor((CASE WHEN staff = 2 THEN 22 ELSE 34 END - strpos('CDEFGAB', step) + 1) / 7.0 + 0.5) + x})).o AS near_octave")
on_notes("b25_type_quarters", "quarters:d", lambda: {"quarters": R.quarters_of_type(C("type"))}, "CASE type WHEN 'whole' THEN 4.0 WHEN 'half' THEN 2.0 WHEN 'quarter' THEN 1.0 WHEN 'eighth' THEN 0.5 ELSE 0.25 END AS quarters")

QUERIES, ORACLES = Q.queries, Q.oracles
