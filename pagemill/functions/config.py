"""Settings of languages and image types, checked when read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ImageType:
    """How many pages an edition has (None: all) and what shares of its images are kept at 100, 75, 50 and 0 %."""

    name: str
    page_limit: int | None
    image_reduction: tuple[int, int, int, int]
    windows: bool = False
    kind: str = "tarball"

    def __post_init__(self) -> None:
        if len(self.image_reduction) != 4 or sum(self.image_reduction) != 100:
            raise ValueError(f"{self.name}: four reductions that sum to 100 are needed")


@dataclass(frozen=True)
class Language:
    code: str
    include: tuple[str, ...] = ()
    portal_index: str | None = None
    second_language: str | None = None
    names: dict[str, str] = field(default_factory=dict)


def image_types(data: dict[str, dict]) -> dict[str, ImageType]:
    """Of a mapping such as a YAML file gives."""
    return {name: ImageType(name, d.get("page_limit"), tuple(d["image_reduction"]), bool(d.get("windows")), d.get("type", "tarball")) for name, d in data.items()}


def languages(data: dict[str, dict]) -> dict[str, Language]:
    return {code: Language(code, tuple(d.get("include") or ()), d.get("portal_index"), d.get("second_language"), dict(d.get("language_name") or {})) for code, d in data.items()}


def image_type_table(spark: SparkSession, types: dict[str, ImageType]) -> DataFrame:
    rows = [(t.name, t.kind, t.windows, t.page_limit, list(t.image_reduction)) for t in types.values()]
    return spark.createDataFrame(rows, "name string, type string, windows boolean, page_limit int, image_reduction array<int>")
