"""Scalar rules as SQL expressions. One rule table gives the expression for Spark and the one for the comparison engine."""

from __future__ import annotations

WORD = "[A-Za-z0-9_]"
#: A word boundary by ASCII letters; the JVM's own one also takes other letters for words.
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


class Spark:
    name = "spark"

    def text(self, s: str) -> str:
        return 'r"' + s + '"' if "'" in s else "r'" + s + "'"

    def pattern(self, p: str, fold: bool = True) -> str:
        return self.text(("(?i)" if fold else "") + p.replace(r"\b", BOUNDARY))

    def match(self, x: str, p: str, fold: bool = True) -> str:
        return f"({x} rlike {self.pattern(p, fold)})"

    def count(self, x: str, p: str, fold: bool = False) -> str:
        return f"regexp_count({x}, {self.pattern(p, fold)})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p, False)}, {self.text(by)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p, False)}, {group})"

    def contains(self, x: str, s: str) -> str:
        return f"contains({x}, {self.text(s)})"

    def words(self, x: str) -> str:
        """Tokens: lower case, split at anything but a-z and 0-9."""
        return f"filter(split(lower({x}), '[^a-z0-9]+'), w -> w <> '')"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.text(p)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def keep(self, a: str, condition: str) -> str:
        return f"filter({a}, w -> {condition})"

    def each(self, a: str, value: str) -> str:
        return f"transform({a}, w -> {value})"

    def array(self, items: list[str]) -> str:
        return "array(" + ", ".join(items) + ")"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def time(self, x: str) -> str:
        return f"try_to_timestamp({x}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

    def seconds(self, x: str) -> str:
        return f"unix_timestamp({x})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.text(by)})"


class Duck(Spark):
    name = "duck"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, p: str, fold: bool = True) -> str:
        return self.text(("(?i)" if fold else "") + p)

    def match(self, x: str, p: str, fold: bool = True) -> str:
        return f"regexp_matches({x}, {self.pattern(p, fold)})"

    def count(self, x: str, p: str, fold: bool = False) -> str:
        return f"len(regexp_extract_all({x}, {self.pattern(p, fold)}))"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p, False)}, {self.text(by)}, 'g')"

    def contains(self, x: str, s: str) -> str:
        return f"contains({x}, {self.text(s)})"

    def words(self, x: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.text(p)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def keep(self, a: str, condition: str) -> str:
        return f"list_filter({a}, lambda w: {condition})"

    def each(self, a: str, value: str) -> str:
        return f"list_transform({a}, lambda w: {value})"

    def array(self, items: list[str]) -> str:
        return "[" + ", ".join(items) + "]"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def time(self, x: str) -> str:
        return f"try_strptime({x}, '%Y-%m-%dT%H:%M:%SZ')"

    def seconds(self, x: str) -> str:
        return f"epoch({x})::BIGINT"

    def join(self, a: str, by: str) -> str:
        return f"coalesce(array_to_string({a}, {self.text(by)}), '')"


SPARK, DUCK = Spark(), Duck()
