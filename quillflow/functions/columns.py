"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a named value.

    A column used several times in an expression is copied into each place; a long chain of such
    uses grows without bound. The variable of a one-element transform is computed once.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def computed(value: Column) -> Column:
    """The value as a column that later filters do not copy below themselves.

    A filter on a derived column is pushed down together with its expression, which then runs
    again for the filter. Nothing is pushed through the output of a one-element explode.
    """
    return F.explode(F.array(value))


# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))
