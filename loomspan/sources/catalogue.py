"""Dimensions of the physics corpus as small tables; every one can be replaced by a caller's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Corpus folder -> source code.
BOOK_SOURCES = {
    "concepts_in_thermal_physics": "Blundell_ThermalPhysics",
    "electricity_and_magnetism": "Purcell_EM",
    "introduction_to_classical_mechanics": "Morin_ClassicalMechanics",
    "introduction_to_electrodynamics": "Griffiths_Electrodynamics",
    "introduction_to_mechanics": "Kleppner_Mechanics",
    "modern_astrophysics": "CarrollOstlie_ModernAstrophysics",
    "physics_of_waves": "Georgi_Waves",
    "quantum_physics": "EisbergResnick_QuantumPhysics",
    "schaums_astronomy": "Palen_SchaumAstronomy",
    "spacetime_physics": "TaylorWheeler_SpacetimePhysics",
    "special_relativity": "French_SpecialRelativity",
}
# Source code -> sub-discipline, and the order the latter are shown in.
SUBDISCIPLINES = {
    "Morin_ClassicalMechanics": "Mechanics",
    "Kleppner_Mechanics": "Mechanics",
    "Purcell_EM": "Electromagnetism",
    "Griffiths_Electrodynamics": "Electromagnetism",
    "Blundell_ThermalPhysics": "Thermal Physics",
    "Georgi_Waves": "Waves",
    "EisbergResnick_QuantumPhysics": "Quantum Physics",
    "French_SpecialRelativity": "Relativity",
    "TaylorWheeler_SpacetimePhysics": "Relativity",
    "CarrollOstlie_ModernAstrophysics": "Astrophysics",
    "Palen_SchaumAstronomy": "Astrophysics",
}
SUBDISCIPLINE_ORDER = ["Mechanics", "Electromagnetism", "Astrophysics", "Quantum Physics", "Thermal Physics", "Relativity", "Waves"]
# Problem type -> domains that teach it.
TYPE_DOMAINS = {
    "mechanics": ["classical_mechanics"],
    "astronomy and astrophysics": ["astrophysics", "classical_mechanics"],
    "electromagnetic fields": ["electromagnetism"],
    "thermodynamics and statistical physics": ["thermal_physics"],
    "quantum physics": ["quantum_physics"],
    "oscillations and waves": ["waves_and_oscillations", "classical_mechanics"],
    "relativity": ["special_relativity"],
}


def book_sources(spark: SparkSession, books: dict[str, str] | None = None) -> DataFrame:
    """(folder, source, sub_discipline, rank) of the catalogue."""
    order = {d: i for i, d in enumerate(SUBDISCIPLINE_ORDER)}
    rows = [(f, s, SUBDISCIPLINES.get(s, "-"), order.get(SUBDISCIPLINES.get(s), len(order))) for f, s in (books or BOOK_SOURCES).items()]
    return spark.createDataFrame(rows, "folder string, source string, sub_discipline string, rank int")


def expected_domains(types: Column | str) -> Column:
    """Sorted distinct domains of an array of problem types; unknown types have none."""
    listed = F.create_map(*(x for k, v in TYPE_DOMAINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = F.transform(T.col(types), lambda t: F.coalesce(F.try_element_at(listed, T.norm_problem_type(t)), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def per_book(corpus: DataFrame, instructions: DataFrame, tests: DataFrame, dims: DataFrame) -> DataFrame:
    """One row per source in any of the tables (source, counts): missing numbers 0, by discipline rank, falling instructions, name."""
    joined = corpus.join(instructions, "source", "full_outer").join(tests, "source", "full_outer").join(dims.select("source", "sub_discipline", "rank"), "source", "left")
    numbers = [c for c, t in joined.dtypes if t in ("bigint", "int", "double") and c != "rank"]
    filled = joined.na.fill(0, numbers).na.fill("-", ["sub_discipline"]).na.fill(len(SUBDISCIPLINE_ORDER), ["rank"])
    first = next((c for c in instructions.columns if c != "source"), "source")
    return filled.orderBy("rank", F.desc(first), "source").drop("rank")
