"""What a test reads out of a small table."""

from veracol.functions.columns import ROW_ID


def values(df, column, order=ROW_ID):
    """A column's values in row order when the row id is there, else sorted."""
    if order in df.columns:
        return [row[0] for row in df.orderBy(order).select(f"`{column}`").collect()]
    return sorted([row[0] for row in df.select(f"`{column}`").collect()], key=lambda v: (v is None, str(v)))
