"""Numbers from samples, and what they allow. Samples are arrays from -1 to 1 at RATE a second."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.operators import intervals as I

RATE = 16_000
#: Samples this large are clipped.
CLIPPED = 0.995
#: Samples of a frame, frames that are looked at, the voice's range in Hz, and what share of the power a voiced lag holds.
FRAME, FRAMES, LOWEST, HIGHEST, VOICED = RATE // 25, 60, 60, 650, 0.3


def _mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x)


def dbfs(samples: Column) -> Column:
    """Level in dB below full scale, -120 at the least and for no samples."""
    return F.when(F.size(samples) == 0, F.lit(-120.0)).otherwise(20.0 * F.log10(F.greatest(F.sqrt(_mean_square(samples)), F.lit(1e-6))))


def levels(rows: DataFrame, samples: str = "samples") -> DataFrame:
    """rows with rms, rms_dbfs, peak_dbfs, change_db (second half against first) and clipped, the share of clipped samples."""
    x = F.col(samples)
    first = F.ceil(F.size(x) / 2).cast("int")
    peak = F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    over = F.aggregate(x, F.lit(0), lambda a, v: a + F.when(F.abs(v) >= CLIPPED, 1).otherwise(0))
    none = F.size(x) == 0
    half = lambda a, n: dbfs(F.slice(x, a, n))
    return rows.withColumns({
        "rms": F.when(none, 0.0).otherwise(F.sqrt(_mean_square(x))),
        "rms_dbfs": dbfs(x),
        "peak_dbfs": 20.0 * F.log10(F.greatest(peak, F.lit(1e-6))),
        "change_db": half(first + 1, F.size(x) - first) - half(F.lit(1), first),
        "clipped": F.when(none, 0.0).otherwise(over / F.size(x)),
    })


def pitch_of(samples) -> tuple[float | None, float | None]:
    """Median pitch in Hz and its variation over up to FRAMES spaced frames, or nothing from fewer than three voiced ones.

    All frames are correlated with themselves at once, through their power
    spectra; the best lag of a voice's range must hold VOICED of the frame's power.
    """
    import numpy as np

    x = np.asarray(samples, dtype=np.float64)
    whole = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)
    if not len(whole):
        return None, None
    picks = np.floor(np.arange(FRAMES) * (len(whole) - 1) / (FRAMES - 1)).astype(int) if len(whole) > FRAMES else np.arange(len(whole))
    frames = whole[picks] - whole[picks].mean(axis=1, keepdims=True)
    frames = frames[np.sqrt(np.mean(frames**2, axis=1)) >= 0.005] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, 2 * FRAME, axis=1)) ** 2
    alike = np.fft.irfft(power, axis=1)
    low, high = RATE // HIGHEST, RATE // LOWEST
    lag = alike[:, low : high + 1].argmax(axis=1) + low
    found = RATE / lag[alike[np.arange(len(lag)), lag] >= VOICED * alike[:, 0]]
    if len(found) < 3:
        return None, None
    middle = float(np.median(found))
    return round(middle, 2), round(float(found.std()) / max(middle, 1.0), 3)


def pitches(rows: DataFrame, samples: str = "samples") -> DataFrame:
    """rows with pitch_hz and pitch_variation, in batches through numpy, which has the correlation that SQL lacks."""

    @F.pandas_udf("struct<hz: double, variation: double>")
    def measure(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pitch_of(v) for v in x], columns=["hz", "variation"], dtype="float64")

    out = rows.withColumn("__pitch", measure(F.col(samples)))
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select(*rows.columns, nan("__pitch.hz").alias("pitch_hz"), nan("__pitch.variation").alias("pitch_variation"))


def tone_eligible(length: Column, rms: Column, clipped: Column, speech: Column) -> Column:
    """A window of length milliseconds, speech of them spoken, is fit for a tone estimate."""
    return (length >= 2500) & (rms >= 0.016) & (clipped <= 0.005) & (2 * speech >= length)


def reference_windows(windows: DataFrame, words: DataFrame) -> DataFrame:
    """windows(recording_id, ord, speaker, s, e, rms, clipped) with speech, disputed, rejected (a rule's name or null), eligible and automatic.

    words(recording_id, s, e, text, speaker, secondary, ambiguous) of the
    window's speaker count. Windows with little recognised speech, silence or
    clipping are rejected; automatic ones are long, spoken and undisputed.
    """
    key = ["recording_id", "ord"]
    met = I.ms_join(windows.select(*key, "speaker", "s", "e"), words.where("s is not null and e is not null")).where("speaker = r_speaker")
    spoken = F.when(F.col("r_text").rlike(r"[\p{L}\p{N}]"), F.least("e", "r_e") - F.greatest("s", "r_s")).otherwise(0)
    odd = F.col("r_ambiguous") | (F.col("r_secondary").isNotNull() & (F.col("r_secondary") != F.col("speaker")))
    per = met.groupBy(*key).agg(F.sum(spoken).alias("speech"), F.max(odd).alias("disputed"))
    rows = windows.join(per, key, "left").withColumn("speech", F.coalesce("speech", F.lit(0))).withColumn("disputed", F.coalesce("disputed", F.lit(False)))
    length = F.col("e") - F.col("s")
    rejected = F.when(F.col("speech") < F.least(F.lit(600.0), length * 0.25), "little_recognized_speech").when((F.col("rms") < 0.002) | (F.col("clipped") > 0.01), "clipping_or_silence")
    rows = rows.withColumn("rejected", rejected)
    good = F.col("rejected").isNull()
    return rows.withColumns({"eligible": good & (length >= 800) & (F.col("speech") >= 200), "automatic": good & ~F.col("disputed") & (length >= 2500) & (F.col("speech") >= 600)})
