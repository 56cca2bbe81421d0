"""Scan limits and parsing options of delimited files, with their validation rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Option vocabularies, limits and messages that callers see.
DELIMITER_CHARACTERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
DELIMITERS = ("auto", "comma", "semicolon", "tab", "pipe", "custom")
ENCODINGS = ("utf8", "utf16le", "latin1")
HEADER_MODES = ("firstNonEmpty", "none")
DECIMAL_SEPARATORS = ("dot", "comma")
THOUSANDS_SEPARATORS = ("none", "comma", "dot", "space")
MAX_SKIP_ROWS = 10_000
MAX_NULL_TOKENS = 20
MAX_NULL_TOKEN_LENGTH = 64
MAX_RECORD_BYTES = 2 * 1024 * 1024
MAX_PREVIEW_CELLS = 250_000
MAX_PREVIEW_EXPANDED_BYTES = 256 * 1024 * 1024

SPARK_ENCODINGS = {"utf8": "UTF-8", "utf16le": "UTF-16LE", "latin1": "ISO-8859-1"}
PYTHON_ENCODINGS = {"utf8": "utf-8", "utf16le": "utf-16-le", "latin1": "latin-1"}


class OptionError(ValueError):
    """A rejected option; ``field`` names the offending setting."""

    def __init__(self, message: str, field: str | None = None):
        super().__init__(message)
        self.message = message
        self.field = field


def clamp_number(value: Any, minimum: float, maximum: float, fallback: float) -> float:
    """Clamp a finite number into ``[minimum, maximum]``; anything else gives ``fallback``."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return fallback
    return max(minimum, min(maximum, value))


def clamp_integer(value: Any, minimum: int, maximum: int, fallback: int) -> int:
    return math.floor(clamp_number(value, minimum, maximum, fallback))


@dataclass(frozen=True)
class Limits:
    """Budgets of previews and scans; out-of-range values are clamped, not refused."""

    preview_rows: int = 2000
    max_columns: int = 500
    max_workbook_mb: float = 100
    max_workbook_expanded_mb: float = 250
    max_profile_scan_mb: float | None = None
    """``None`` leaves full scans unlimited; a number is clamped to 64..8192."""

    def __post_init__(self):
        set_ = object.__setattr__
        set_(self, "preview_rows", clamp_integer(self.preview_rows, 100, 5000, 2000))
        set_(self, "max_columns", clamp_integer(self.max_columns, 10, 2000, 500))
        set_(self, "max_workbook_mb", clamp_number(self.max_workbook_mb, 1, 1000, 100))
        set_(
            self,
            "max_workbook_expanded_mb",
            clamp_number(self.max_workbook_expanded_mb, 10, 2000, 250),
        )
        if self.max_profile_scan_mb is not None:
            set_(
                self,
                "max_profile_scan_mb",
                clamp_number(self.max_profile_scan_mb, 64, 8192, 1024),
            )

    def head_rows(self, column_count: int) -> int:
        """Rows of a preview under both the row limit and the cell budget."""
        return min(self.preview_rows, max(1, MAX_PREVIEW_CELLS // max(1, column_count)))


def _single_safe_character(value: Any) -> bool:
    return isinstance(value, str) and len(value) == 1 and value not in "\r\n\0"


@dataclass(frozen=True)
class DelimitedOptions:
    """How to read delimited text. Construction validates; a bad value raises ``OptionError``."""

    delimiter: str = "auto"
    custom_delimiter: str | None = None
    encoding: str = "utf8"
    header: str = "firstNonEmpty"
    skip_rows: int = 0
    quote: str = '"'
    escape: str = '"'
    null_tokens: tuple[str, ...] = field(default=())
    decimal_separator: str = "dot"
    thousands_separator: str = "none"

    def __post_init__(self):
        for check in (self._check_shape, self._check_characters, self._check_nulls, self._check_numbers):
            check()

    def _check_shape(self):
        if self.delimiter not in DELIMITERS:
            raise OptionError("Select a supported delimiter.", "delimiter")
        if self.delimiter == "custom" and not _single_safe_character(self.custom_delimiter):
            raise OptionError(
                "Custom delimiter must be one non-line-break character.", "customDelimiter"
            )
        if self.encoding not in ENCODINGS:
            raise OptionError("Select a supported encoding.", "encoding")
        if self.header not in HEADER_MODES:
            raise OptionError("Select a supported header mode.", "header")
        rows = self.skip_rows
        if isinstance(rows, float) and rows.is_integer():
            rows = int(rows)
            object.__setattr__(self, "skip_rows", rows)
        if isinstance(rows, bool) or not isinstance(rows, int) or not 0 <= rows <= MAX_SKIP_ROWS:
            raise OptionError("Rows to skip must be an integer from 0 to 10,000.", "skipRows")

    def _check_characters(self):
        if not _single_safe_character(self.quote):
            raise OptionError("Quote must be one non-line-break character.", "quote")
        if not _single_safe_character(self.escape):
            raise OptionError("Escape must be one non-line-break character.", "escape")
        if self.separator is not None and self.separator == self.quote:
            raise OptionError("Delimiter and quote must be different characters.", "delimiter")

    def _check_nulls(self):
        tokens = self.null_tokens
        if not isinstance(tokens, (list, tuple)) or len(tokens) > MAX_NULL_TOKENS:
            raise OptionError("Enter at most 20 null tokens.", "nullTokens")
        for token in tokens:
            if not isinstance(token, str) or not 1 <= len(token) <= MAX_NULL_TOKEN_LENGTH:
                raise OptionError("Each null token must contain 1 to 64 characters.", "nullTokens")
        object.__setattr__(self, "null_tokens", tuple(dict.fromkeys(tokens)))

    def _check_numbers(self):
        if self.decimal_separator not in DECIMAL_SEPARATORS:
            raise OptionError("Select a supported decimal separator.", "decimalSeparator")
        if self.thousands_separator not in THOUSANDS_SEPARATORS:
            raise OptionError("Select a supported thousands separator.", "thousandsSeparator")
        if self.decimal_separator == self.thousands_separator:
            raise OptionError(
                "Decimal and thousands separators must be different.", "thousandsSeparator"
            )

    @property
    def separator(self) -> str | None:
        """The chosen separator character, ``None`` when it is to be detected."""
        if self.delimiter == "custom":
            return self.custom_delimiter
        return DELIMITER_CHARACTERS.get(self.delimiter)

    @property
    def spark_encoding(self) -> str:
        return SPARK_ENCODINGS[self.encoding]

    @property
    def localized(self) -> bool:
        """Whether fields are tested for localized numbers at all."""
        return (self.decimal_separator, self.thousands_separator) != ("dot", "none")

    def with_(self, **changes: Any) -> DelimitedOptions:
        return replace(self, **changes)

    @classmethod
    def from_dict(cls, value: Any) -> DelimitedOptions:
        """Build from a saved camelCase or snake_case record; unknown keys are ignored."""
        if not isinstance(value, dict):
            raise OptionError("Parsing settings must be an object.")
        known = {}
        for item in fields(cls):
            head, *rest = item.name.split("_")
            camel = head + "".join(part.title() for part in rest)
            if camel in value:
                known[item.name] = value[camel]
            elif item.name in value:
                known[item.name] = value[item.name]
        return cls(**known)


@dataclass(frozen=True)
class ParsingMetadata:
    """Which separator was found, which one was used, and the options applied."""

    detected_delimiter: str
    resolved_delimiter: str
    applied: DelimitedOptions
