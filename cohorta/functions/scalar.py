"""Column functions: cleaning, flags, probabilities and banded messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Statuses of the cascade.
NON_ADMIS = "NON ADMIS"
DEUXIEME_SESSION = "DEUXIÈME SESSION"
PASSABLE = "PASSABLE"
MENTION_SUPERIEURE = "MENTION SUPÉRIEURE"
ERREUR = "ERREUR"

# Weight of each status in the first and the second success probability.
STATUS_WEIGHTS_V1 = {MENTION_SUPERIEURE: 0.95, PASSABLE: 0.75, DEUXIEME_SESSION: 0.40, NON_ADMIS: 0.10}
STATUS_WEIGHTS_V2 = {NON_ADMIS: 0.10, DEUXIEME_SESSION: 0.50, PASSABLE: 0.70, MENTION_SUPERIEURE: 0.95}

# Score shifts of the second and third ensemble.
STATUS_SHIFTS = {DEUXIEME_SESSION: -1000.0, PASSABLE: -5000.0, MENTION_SUPERIEURE: -10000.0}

# Bonuses that are defined but not applied by default.
MENTION_BONUSES = {"Bien": 0.10, "Assez-Bien": 0.07, "Passable": 0.03}
SERIE_BONUSES = {"S1": 0.07, "S3": 0.07, "S2": 0.03}

# Scales and caps.
SCORE_MAX = 120.0
SCORE_SCALE = 20.0
PROBABILITY_CAP = 95.0
CAPACITY = 800

# Message by lower probability bound, highest first; None is the rest.
ADVICE_V1 = (
    (75, "Très grande chance de réussite. Votre profil est adéquat pour la formation."),
    (50, "Grande chance de réussite. Votre profil est adéquat pour la formation."),
    (25, "Faible chance de réussite. Votre profil peut ne pas être adéquat pour la formation."),
    (None, "Très faible chance de réussite. Votre profil n'est probablement pas adéquat pour la formation."),
)
ADVICE_ORIENTATION = (
    (75, "Vous avez une très grande chance d'être orienté vers la filière."),
    (50, "Vous avez une grande chance d'être orienté vers la filière."),
    (25, "Vous avez une faible chance d'être orienté vers la filière."),
    (None, "Vous avez une très faible chance d'être orienté vers la filière."),
)
ADVICE_SUCCESS = (
    (95, "Vous avez une très grande chance de réussir dans la filière."),
    (70, "Vous avez une grande chance de réussir dans la filière."),
    (50, "Vous avez une faible chance de réussir dans la filière."),
    (10, "Vous avez une très faible chance de réussir dans la filière."),
    (None, "Vous avez une probabilité extrêmement faible de réussir dans la filière."),
)
ADVICE_UNKNOWN_KIND = "Type de probabilité invalide. Veuillez utiliser 'orientation' ou 'success'."


def as_column(value: Column | str) -> Column:
    """A column from its name; names may hold dots, accents and quotes."""
    return F.col("`" + value.replace("`", "``") + "`") if isinstance(value, str) else value


def parse_number(text: Column | str) -> Column:
    """Text to number, spaces around it ignored; null when it is not one.

    A cast alone would also take the type suffixes and hexadecimal of Java.
    """
    trimmed = F.trim(as_column(text))
    return F.when(~trimmed.rlike("[0-9.][dDfF]$|[xX]"), trimmed.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A column of the frame as a number; only text columns are parsed."""
    if isinstance(df.schema[name].dataType, StringType):
        return parse_number(name)
    return as_column(name).try_cast("double")


def number_or_zero(df: DataFrame, name: str) -> Column:
    """A column of the frame as a number; null, NaN and unparsable text become 0."""
    return F.coalesce(F.nanvl(number(df, name), F.lit(0.0)), F.lit(0.0))


def one_zero(value: Column) -> Column:
    """Negative zero as zero: the two are equal, but not to a search by bits or buckets."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def rounded(value: Column, digits: int) -> Column:
    """Round to the nearest, exact halves to the even digit."""
    power = F.lit(10.0**digits)
    return F.rint(value * power) / power


def equals_flag(value: Column | str, expected: str) -> Column:
    """1 where the value equals ``expected``, else 0 (also for null)."""
    return F.coalesce((as_column(value) == F.lit(expected)).cast("int"), F.lit(0))


def lookup(key: Column | str, table: Mapping[str, float], default: float | None = 0.0) -> Column:
    """Value of a small fixed map by key, with a default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), as_column(key)), F.lit(default))


def capped(value: Column, cap: float) -> Column:
    """Upper limit that keeps null (``least`` alone would return the cap)."""
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


def normalise_score(score: Column | str, score_max: float = SCORE_MAX, scale: float = SCORE_SCALE) -> Column:
    """Score on a 0-20 scale, capped above, not below."""
    return capped(as_column(score) / F.lit(score_max) * F.lit(scale), scale)


def score_percentage(normalised: Column, scale: float = SCORE_SCALE) -> Column:
    return normalised / F.lit(scale) * F.lit(100.0)


def success_percentage(
    base: Column, percentage: Column, bonus: Column | None = None, cap: float = PROBABILITY_CAP
) -> Column:
    """Status weight times score share, in percent, capped."""
    raw = base if bonus is None else base + bonus
    return capped(raw * F.lit(100.0) * (percentage / F.lit(100.0)), cap)


def orientation_percentage(rank: Column | str, capacity: Column | int = CAPACITY) -> Column:
    """Share of the capacity that ranks behind the applicant, in percent."""
    seats = (F.lit(capacity) if isinstance(capacity, int) else capacity).cast("double")
    return (seats - as_column(rank)) / seats * F.lit(100.0)


def banded(probability: Column | str, bands: tuple[tuple[int | None, str], ...]) -> Column:
    """Message of the first band whose lower bound the probability reaches."""
    value = as_column(probability)
    text = F.lit(bands[-1][1])
    for bound, message in reversed(bands[:-1]):
        text = F.when(value >= F.lit(float(bound)), F.lit(message)).otherwise(text)
    return F.when(value.isNotNull(), text)


def advice_v1(probability: Column | str) -> Column:
    return banded(probability, ADVICE_V1)


def advice_v2(probability: Column | str, kind: Column | str) -> Column:
    """Message by kind; ``kind`` is a column or one of the two literal kinds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "orientation", banded(probability, ADVICE_ORIENTATION))
        .when(kind == "success", banded(probability, ADVICE_SUCCESS))
        .otherwise(F.lit(ADVICE_UNKNOWN_KIND))
    )
