"""DataFrame -> DataFrame operators; each composes with ``DataFrame.transform``."""
