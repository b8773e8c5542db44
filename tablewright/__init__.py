"""tablewright: raw tables to evaluated models, written as Spark jobs."""

from tablewright.spec import DatasetSpec

__all__ = ["DatasetSpec"]
