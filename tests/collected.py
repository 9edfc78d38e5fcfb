"""Results as plain values."""


def rows(df, *order):
    """Collected rows as tuples, sorted unless an order is kept by the caller."""
    data = [tuple(r) for r in df.collect()]
    return data if order else sorted(data, key=str)
