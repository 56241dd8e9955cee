"""Scalar expressions as SQL text for Spark, and for a second engine that tests compare with."""

from __future__ import annotations


class Dialect:
    """The few spellings in which the two engines differ."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def text(self, value: str) -> str:
        """A string literal, taken as it stands."""
        if self.spark and "'" not in value:
            return f"r'{value}'"
        return "'" + (value.replace("\\", "\\\\").replace("'", "\\'") if self.spark else value.replace("'", "''")) + "'"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        """All matches replaced."""
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}" + (")" if self.spark else ", 'g')")

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def group(self, x: str, pattern: str, n: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {n})"

    def count(self, x: str, chars: str) -> str:
        """How many characters of a class (the inside of brackets)."""
        return f"length({self.sub(x, f'[^{chars}]')})"

    def fn(self, names: str, body: str) -> str:
        shown = f"({names})" if "," in names else names
        return f"{shown} -> {body}" if self.spark else f"lambda {names}: {body}"

    def filter(self, x: str, name: str, test: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({x}, {self.fn(name, test)})"

    def map(self, x: str, name: str, value: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({x}, {self.fn(name, value)})"

    def size(self, x: str) -> str:
        return f"{'size' if self.spark else 'len'}({x})"

    def split(self, x: str) -> str:
        """Parts between single spaces, without empty ones."""
        parts = f"split({x}, ' ')" if self.spark else f"string_split({x}, ' ')"
        return self.filter(parts, "part", "part <> ''")

    def all(self, x: str, pattern: str) -> str:
        """All matches, in order."""
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)" if self.spark else f"regexp_extract_all({x}, {self.text(pattern)})"

    def at(self, x: str, n: int) -> str:
        """The n-th element from 1, from the end if negative; null if there is none."""
        return f"try_element_at({x}, {n})" if self.spark else f"{x}[{n}]"

    def join(self, x: str, by: str = " ") -> str:
        return f"array_join({x}, {self.text(by)})" if self.spark else f"array_to_string({x}, {self.text(by)})"

    def upper(self, x: str) -> str:
        """Capitals letter by letter: a sharp s has none."""
        return f"replace(upper(replace({x}, 'ß', chr(1))), chr(1), 'ß')"

    def half_even(self, x: str) -> str:
        return f"rint({x})" if self.spark else f"round_even({x}, 0)"

    def integer(self, x: str) -> str:
        return f"CAST({x} AS int)" if self.spark else f"CAST({x} AS INTEGER)"

    def divided(self, a: str, b: str) -> str:
        """Integer division of integers."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"


SPARK = Dialect(True)
DUCKDB = Dialect(False)
