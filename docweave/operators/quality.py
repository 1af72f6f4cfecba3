"""Quality of images: scores of measured values, the gate's status and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import DEFAULT, EngineConfig

# Lower bounds of a value and their scores, then the score below all.
SHARPNESS = ((400, 100), (200, 90), (100, 75), (50, 55), (25, 40)), 20
CONTRAST = ((55, 100), (40, 90), (25, 75), (15, 55), (8, 40)), 20
ETA = ((0.50, 100), (0.35, 85), (0.25, 70), (0.15, 55), (0.08, 40)), 20
DENSITY = ((0.015, 100), (0.008, 85), (0.004, 70), (0.001, 50)), 20
PIXELS = ((2_000_000, 100), (1_000_000, 90), (500_000, 80), (250_000, 70), (120_000, 60), (60_000, 45), (30_000, 30)), 10
CHAR_HEIGHT = ((20, 100), (14, 90), (10, 80), (7, 65), (4, 45)), 10
#: Upper bounds (exclusive) of the reflection ratio.
REFLECTION = ((0.05, 100), (0.15, 85), (0.30, 70), (0.50, 45)), 20
WEIGHTS = {"sharpness": 0.30, "contrast": 0.25, "eta": 0.20, "resolution": 0.15, "density": 0.05, "reflection": 0.03, "brightness": 0.02}


def at_least(value: Column, steps) -> Column:
    bounds, low = steps
    out = F.when(value >= bounds[0][0], bounds[0][1])
    for bound, score in bounds[1:]:
        out = out.when(value >= bound, score)
    return out.otherwise(low)


def below(value: Column, steps) -> Column:
    bounds, high = steps
    out = F.when(value < bounds[0][0], bounds[0][1])
    for bound, score in bounds[1:]:
        out = out.when(value < bound, score)
    return out.otherwise(high)


def brightness_score(v: Column) -> Column:
    return (
        F.when(v.between(70, 250), 100)
        .when(((v >= 50) & (v < 70)) | ((v > 250) & (v <= 253)), 85)
        .when(((v >= 35) & (v < 50)) | ((v > 253) & (v <= 255)), 70)
        .otherwise(30)
    )


def resolution_score(width: Column, height: Column, char_height: Column) -> Column:
    """Pixels and height of characters, 6 to 4, rounded half to even."""
    pixels = width.cast("long") * height.cast("long")
    return F.bround(at_least(pixels, PIXELS) * F.lit(0.6) + at_least(char_height, CHAR_HEIGHT) * F.lit(0.4)).cast("int")


def scores(metrics: DataFrame) -> DataFrame:
    """metrics with a score for each of its values (see schemas.METRICS)."""
    c = F.col
    return metrics.withColumns({
        "sharpness_score": at_least(c("sharpness"), SHARPNESS), "contrast_score": at_least(c("contrast"), CONTRAST), "eta_score": at_least(c("eta"), ETA),
        "resolution_score": resolution_score(c("width"), c("height"), c("char_height")), "density_score": at_least(c("density"), DENSITY),
        "reflection_score": below(c("reflection"), REFLECTION), "brightness_score": brightness_score(c("brightness")),
    })


def combine(scored: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """scored with critical_min, score, status and reasons.

    The score is the weighted sum, but at most 15 above the worst critical score; the resolution is critical unless the
    text is flawless.
    """
    c = F.col
    weighted = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weighted += c(f"{name}_score") * F.lit(w)
    flawless = (c("eta") > 0.85) & (c("sharpness") > 4000) & (c("contrast") > 150)
    text = F.least("sharpness_score", "contrast_score", "eta_score")
    out = scored.withColumn("critical_min", F.when(flawless, text).otherwise(F.least(text, c("resolution_score"))))
    out = out.withColumn("score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted, c("critical_min") + F.lit(15.0)))).cast("int"))
    hard = (
        (c("width") < config.min_width) | (c("height") < config.min_height) | (c("char_height") < config.min_char_height)
        | (c("critical_min") < config.critical_floor) | (c("density") < 0.001)
    )
    status = F.when(hard, "REJECTED").when(c("score") >= config.accept_threshold, "ACCEPTED").when(c("score") >= config.warning_threshold, "WARNING").otherwise("REJECTED")
    return out.withColumn("status", status).withColumn("reasons", reasons(config))


def judge(m: dict[str, float], config: EngineConfig = DEFAULT) -> tuple[str, int, int]:
    """(status, score of sharpness, score of contrast) of one image's measured values: :func:`combine` for a worker that must know
    at once whether to read an image. Both give the same status (tested over a grid of values)."""
    def pick(value: float, steps, good=lambda v, b: v >= b) -> int:
        bounds, rest = steps
        return next((score for bound, score in bounds if good(value, bound)), rest)

    v = m["brightness"]
    light = 100 if 70 <= v <= 250 else 85 if 50 <= v < 70 or 250 < v <= 253 else 70 if 35 <= v < 50 or 253 < v <= 255 else 30
    s = {
        "sharpness": pick(m["sharpness"], SHARPNESS), "contrast": pick(m["contrast"], CONTRAST), "eta": pick(m["eta"], ETA),
        "resolution": round(pick(m["width"] * m["height"], PIXELS) * 0.6 + pick(m["char_height"], CHAR_HEIGHT) * 0.4), "density": pick(m["density"], DENSITY),
        "reflection": pick(m["reflection"], REFLECTION, lambda v, b: v < b), "brightness": light,
    }
    text = min(s["sharpness"], s["contrast"], s["eta"])
    critical = text if m["eta"] > 0.85 and m["sharpness"] > 4000 and m["contrast"] > 150 else min(text, s["resolution"])
    weighted = 0.0
    for name, w in WEIGHTS.items():
        weighted += s[name] * w
    score = round(max(0.0, min(100.0, weighted, critical + 15.0)))
    hard = m["width"] < config.min_width or m["height"] < config.min_height or m["char_height"] < config.min_char_height or critical < config.critical_floor or m["density"] < 0.001
    status = "REJECTED" if hard else "ACCEPTED" if score >= config.accept_threshold else "WARNING" if score >= config.warning_threshold else "REJECTED"
    return status, s["sharpness"], s["contrast"]


def reasons(config: EngineConfig = DEFAULT) -> Column:
    c, low = F.col, lambda n: F.col(f"{n}_score") < 60
    size = F.concat(
        F.lit("Résolution trop faible ("), c("width").cast("string"), F.lit("x"), c("height").cast("string"), F.lit(" px) — minimum requis : "),
        F.lit(f"{config.min_width}x{config.min_height} px"),
    )
    small = F.concat(F.lit("Taille des caractères trop petite ("), F.format_string("%.1f", c("char_height")), F.lit(f" px) — minimum requis : {config.min_char_height:g} px"))
    # The wording of the reasons.
    dark = F.when(c("brightness") < 60, "trop sombre").otherwise("trop claire")
    return F.array_compact(F.array(
        F.when((c("width") < config.min_width) | (c("height") < config.min_height), size),
        F.when(c("char_height") < config.min_char_height, small),
        F.when(low("sharpness"), "Netteté des caractères insuffisante (texte flou)"),
        F.when(low("contrast"), "Contraste local entre le texte et l'arrière-plan trop faible"),
        F.when(low("eta"), "Lisibilité de la binarisation du texte dégradée"),
        F.when(low("resolution"), "Résolution ou taille des caractères insuffisante pour une extraction fiable"),
        F.when(low("density"), "Densité de structures textuelles très faible (texte absent ou illisible)"),
        F.when(low("reflection"), "Reflets ou éblouissements importants détectés sur le document"),
        F.when(low("brightness"), F.concat(F.lit("Luminosité globale inadaptée ("), dark, F.lit(")"))),
    ))
