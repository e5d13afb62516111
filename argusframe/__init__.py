"""argusframe: security analytics over tables of source files and captured
web exchanges, written as Spark DataFrame transformations."""

from argusframe.plans.scan import Engine, ScanOptions
from argusframe.session import build_session

__all__ = ["Engine", "ScanOptions", "build_session"]
