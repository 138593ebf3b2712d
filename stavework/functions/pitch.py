"""Pitch arithmetic as column expressions. Steps are letters C to B; a diatonic index counts staff positions from C0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "CDEFGAB"
SHARP_ORDER, FLAT_ORDER = "FCGDAEB", "BEADGCF"


def step_index(step: Column) -> Column:
    return F.instr(F.lit(STEPS), step) - 1


def diatonic_index(step: Column, octave: Column) -> Column:
    return step_index(step) + 7 * octave


def pitch_from_diatonic(index: Column) -> tuple[Column, Column]:
    """Step and octave; the remainder is not negative."""
    return F.substring(F.lit(STEPS), (F.pmod(index, F.lit(7)) + 1).cast("int"), F.lit(1)), F.floor(index / 7).cast("int")


def semitone(step: Column) -> Column:
    return 2 * step_index(step) - F.when(step_index(step) > 2, 1).otherwise(0)


def chroma(step: Column, alter: Column, octave: Column) -> Column:
    """Semitones from C0."""
    return 12 * octave + semitone(step) + alter


def midi_number(step: Column, alter: Column, octave: Column) -> Column:
    return chroma(step, alter, octave) + 12


def frequency(step: Column, alter: Column, octave: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi_number(step, alter, octave) - 69) / 12)


def pitch_from_midi(number: Column) -> tuple[Column, Column, Column]:
    """Step, alter and octave, black keys as sharps."""
    key = (number % 12).cast("int")
    return F.substring(F.lit("CCDDEFFGGAAB"), key + 1, F.lit(1)), F.substring(F.lit("010100101010"), key + 1, F.lit(1)).cast("int"), (F.floor(number / 12) - 1).cast("int")


def key_alter(step: Column, fifths: Column) -> Column:
    """What a key signature of so many sharps (negative: flats) does to a step."""
    return F.when((fifths > 0) & (F.instr(F.lit(SHARP_ORDER), step) <= fifths), 1).when((fifths < 0) & (F.instr(F.lit(FLAT_ORDER), step) <= -fifths), -1).otherwise(0)


def moved(step: Column, octave: Column, by: Column, fifths: Column) -> tuple[Column, Column, Column]:
    """Step, alter and octave so many staff positions higher, inside the key."""
    new_step, new_octave = pitch_from_diatonic(diatonic_index(step, octave) + by)
    return new_step, key_alter(new_step, fifths), new_octave


def pitch_text(step: Column, alter: Column, octave: Column) -> Column:
    return F.concat(step, F.repeat(F.lit("#"), F.greatest(alter, F.lit(0)).cast("int")), F.repeat(F.lit("b"), F.greatest(-alter, F.lit(0)).cast("int")), octave.cast("string"))


def near_staff_octave(step: Column, bass: Column) -> Column:
    """The octave that puts a letter nearest to the staff's middle (B4, bass D3); of two as near, the lower."""
    middle = F.when(bass, 3 * 7 + 1).otherwise(4 * 7 + 6)
    guess = F.floor((middle - step_index(step)) / 7 + 0.5).cast("int")
    return F.array_min(F.transform(F.array(guess - 1, guess, guess + 1), lambda o: F.struct(F.abs(o * 7 + step_index(step) - middle).alias("d"), o.alias("o"))))["o"]
