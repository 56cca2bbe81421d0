import pytest

from colscope.options import DelimitedOptions, Limits, OptionError


@pytest.mark.parametrize(
    "given, field, message",
    [
        ({"delimiter": "colon"}, "delimiter", "Select a supported delimiter."),
        ({"delimiter": "custom", "custom_delimiter": "\n"}, "customDelimiter", "Custom delimiter must be one"),
        ({"delimiter": "custom"}, "customDelimiter", "Custom delimiter must be one"),
        ({"encoding": "cp1252"}, "encoding", "Select a supported encoding."),
        ({"header": "last"}, "header", "Select a supported header mode."),
        ({"skip_rows": 10_001}, "skipRows", "Rows to skip must be an integer from 0 to 10,000."),
        ({"skip_rows": -1}, "skipRows", "Rows to skip"),
        ({"skip_rows": 1.5}, "skipRows", "Rows to skip"),
        ({"quote": ""}, "quote", "Quote must be one"),
        ({"escape": "ab"}, "escape", "Escape must be one"),
        ({"delimiter": "comma", "quote": ","}, "delimiter", "Delimiter and quote must be different"),
        ({"null_tokens": [str(i) for i in range(21)]}, "nullTokens", "Enter at most 20 null tokens."),
        ({"null_tokens": [""]}, "nullTokens", "Each null token"),
        ({"null_tokens": ["x" * 65]}, "nullTokens", "Each null token"),
        ({"decimal_separator": "x"}, "decimalSeparator", "Select a supported decimal"),
        ({"thousands_separator": "x"}, "thousandsSeparator", "Select a supported thousands"),
        ({"decimal_separator": "comma", "thousands_separator": "comma"}, "thousandsSeparator", "must be different"),
        ({"decimal_separator": "dot", "thousands_separator": "dot"}, "thousandsSeparator", "must be different"),
    ],
)
def test_rejected_options(given, field, message):
    with pytest.raises(OptionError, match=message[:20]) as caught:
        DelimitedOptions(**given)
    assert caught.value.field == field


def test_saved_options_are_restored_and_deduplicated():
    options = DelimitedOptions.from_dict(
        {"delimiter": "custom", "customDelimiter": "^", "nullTokens": ["NA", "NA", "NULL"],
         "decimalSeparator": "comma", "thousandsSeparator": "dot", "skipRows": 2}
    )
    assert options.separator == "^"
    assert options.null_tokens == ("NA", "NULL")
    assert options.localized and options.skip_rows == 2
    with pytest.raises(OptionError, match="must be an object"):
        DelimitedOptions.from_dict([])


def test_limits_clamp():
    limits = Limits(preview_rows=99, max_columns=5000, max_workbook_mb=float("nan"), max_profile_scan_mb=1)
    assert limits.preview_rows == 100 and limits.max_columns == 2000
    assert limits.max_workbook_mb == 100 and limits.max_profile_scan_mb == 64
    assert Limits(preview_rows=5000).head_rows(500) == 500
    assert Limits().head_rows(1) == 2000
