"""Where the test tables are, and how rows are compared."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    """The rows of a pandas frame, columns by name, in an order of their own."""
    df = df[sorted(df.columns)]
    return sorted(repr(tuple("nan" if isinstance(x, float) and x != x else x for x in r)) for r in df.itertuples(index=False, name=None))
