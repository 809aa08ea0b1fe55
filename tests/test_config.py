"""Configuration surface: custom patterns, new profiles, thresholds."""

from simlattice.config import (DEFAULT_PROFILES, DetectorConfig, LanguageProfile, register_profile,
                               update_patterns)


def test_custom_try_pattern_registers(analyze):
    prof = update_patterns(DEFAULT_PROFILES, "python", {"TRY": ["try_statement"]})
    code = "try:\n    for i in x:\n        pass\nexcept E:\n    pass\n"
    assert list(analyze([("python", code)], prof)[0].patterns) == ["TRY:d0", "LOOP:d1"]
    # the default table is untouched (no shared mutable state)
    assert list(analyze([("python", code)])[0].patterns) == ["LOOP:d0"]
    assert "TRY" not in DEFAULT_PROFILES["python"].pattern_mappings


def test_update_unknown_language_raises():
    import pytest
    with pytest.raises(ValueError):
        update_patterns(DEFAULT_PROFILES, "cobol", {"X": ["y"]})


def test_register_profile(analyze):
    kotlin = LanguageProfile(name="kotlin", lexer="brace", extensions=(".kt",),
                             structural_nodes=("if_statement", "for_statement", "while_statement"),
                             pattern_mappings={"LOOP": ("for_statement", "while_statement"), "COND": ("if_statement",)})
    prof = register_profile(DEFAULT_PROFILES, kotlin)
    out = analyze([("kotlin", "for (x in xs) { if (x > 0) { println(x) } }")], prof)
    assert list(out[0].patterns) == ["LOOP:d0", "COND:d1"]


def test_detector_config_validates():
    import pytest
    assert DetectorConfig().hash_bits == 256
    with pytest.raises(ValueError):
        DetectorConfig(hash_bits=100)


def test_strict_thresholds_change_verdict(compare):
    from snippets import GRID_PY, GUARD_PY
    loose = compare(GRID_PY, "python", GUARD_PY, "python")
    strict = compare(GRID_PY, "python", GUARD_PY, "python",
                     cfg=DetectorConfig(high_confidence_threshold=0.99, medium_confidence_threshold=0.99,
                                        plagiarism_threshold=0.99))
    assert strict["plagiarism_detected"] is False
    assert loose["similarity"] == strict["similarity"]
