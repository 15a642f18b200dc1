"""Event codes. Functions take an :class:`EventCodes`, so other logs only need other names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# The code names of the hospital log and the sets of codes that are reported together.
@dataclass(frozen=True)
class EventCodes:
    death: str = "STATE2_DECES"
    lost: str = "STATE2_PDV"
    no_illness: str = "STATE1_NO_PATHOL1"
    illness: str = "pathol12"

    @property
    def terminal(self) -> tuple[str, str]:
        return (self.death, self.lost)


GROUP_FLAGS: dict[str, tuple[str, ...]] = {
    "all_cancers": (
        "CANCER1_AUD_SMOKER", "CANCER1_COLORECTAL", "CANCER1_HEMATO", "CANCER1_PC_GOOD",
        "CANCER1_PC_POOR", "CANCER1_SMOKER", "CANCER1_BREAST", "CANCER1_PROSTATE",
    ),
    "cancer_poor": ("CANCER1_AUD_SMOKER", "CANCER1_PC_POOR", "CANCER1_SMOKER"),
    "cancer_good": (
        "CANCER1_BREAST", "CANCER1_COLORECTAL", "CANCER1_HEMATO", "CANCER1_PC_GOOD", "CANCER1_PROSTATE",
    ),
    "vasc": ("CARDIO1_IHD_1MI", "CV1_PVD", "STROKE1_1HEMO", "STROKE1_1ISCHEMIC"),
    "vasc_other": ("CV1_PVD", "STROKE1_1HEMO", "STROKE1_1ISCHEMIC"),
    "organ_failure": (
        "CARDIO1_INSUF_CHRO", "DIG1_LIVER_1CirrD", "KIDNEY1_1INSUF_CHRO", "RESP1_1INSUF_CHRO",
    ),
    "organ_other": ("DIG1_LIVER_1CirrD", "KIDNEY1_1INSUF_CHRO", "RESP1_1INSUF_CHRO"),
}

# Which event_censor codes count as an accepted death under each policy.
DEATH_POLICIES: dict[str, tuple[int, ...]] = {
    "observed": (0,),
    "observed_or_severe": (0, 1),
    "imputed": (0, 1, 2),
    "imputed_sp95": (0, 1, 3),
}


def code_level(code: str | Column) -> Column:
    """Severity level of a code: its first digit among 0, 1, 2."""
    c = F.col(code) if isinstance(code, str) else code
    level = F.regexp_extract(c, "[012]", 0)
    return F.when(level != "", level)


def code_type(code: str | Column) -> Column:
    """Family of a code: the part before the first underscore."""
    c = F.col(code) if isinstance(code, str) else code
    return F.substring_index(c, "_", 1)
