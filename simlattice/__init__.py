"""simlattice: structural fingerprints and similarity search on Spark."""

from .config import (DEFAULT_PROFILES, CPP, HTML, JAVA, PYTHON, TEXT, DetectorConfig, LanguageProfile,
                     register_profile, update_patterns)

__all__ = ["DEFAULT_PROFILES", "PYTHON", "JAVA", "CPP", "HTML", "TEXT", "DetectorConfig", "LanguageProfile",
           "register_profile", "update_patterns"]
