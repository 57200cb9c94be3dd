"""The affinity sources that are integrated, in integration order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class AffinitySource:
    """Where one source lives and which of its columns carry the measurement."""

    name: str
    file: str
    format: str
    drug_col: str
    target_col: str
    score_col: str
    concentration: bool

    @property
    def affinity_type(self) -> str:
        """Concentrations are reported on the p-scale, other scores as they are."""
        return f"p{self.name}" if self.concentration else self.name


def _structure_form(name: str, file: str) -> AffinitySource:
    return AffinitySource(name, file, "csv", "compound_iso_smiles", "target_sequence", "affinity", False)


def _id_form(name: str, file: str) -> AffinitySource:
    return AffinitySource(name, file, "tsv", "drug_id", "target_id", "affinity", True)


# Source names, file names and their column names.
SOURCES: tuple[AffinitySource, ...] = (
    _structure_form("Davis", "davis_all.csv"),
    _structure_form("KIBA", "kiba_all.csv"),
    _id_form("IC50", "IC50_bind.tsv"),
    _id_form("Kd", "Kd_bind.tsv"),
    _id_form("Ki", "Ki_bind.tsv"),
    _id_form("EC50", "EC50_bind.tsv"),
)


def source_names(sources: Sequence[AffinitySource] = SOURCES) -> list[str]:
    return [s.name for s in sources]


def concentration_names(sources: Sequence[AffinitySource] = SOURCES) -> list[str]:
    return [s.name for s in sources if s.concentration]
