"""Rows and text for drawing the boxes of trees of the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions.keys import power2
from quadrille.operators.tree import Tree


def rectangles(tree: Tree, leaves_only: bool = True) -> DataFrame:
    """The corners of the boxes: x0, y0, x1, y1."""
    step = F.lit(tree.width) / power2(F.col("level"))
    boxes = tree.leaves() if leaves_only else tree.boxes
    at = lambda i, k, more: F.lit(tree.lo[i]) + (F.col(k) + more) * step
    return boxes.select("level", "ix", "iy", at(0, "ix", 0).alias("x0"), at(1, "iy", 0).alias("y0"), at(0, "ix", 1).alias("x1"), at(1, "iy", 1).alias("y1"))


def tikz_lines(tree: Tree) -> DataFrame:
    """A line of TikZ that draws each leaf, with five decimals."""
    r = rectangles(tree)
    return r.select("level", "ix", "iy", F.format_string("\\draw (%.5f,%.5f) rectangle (%.5f,%.5f);", "x0", "y0", "x1", "y1").alias("line"))


def roman(n: Column) -> Column:
    """A number from 1 to 3999 in roman numerals."""
    # The digits for each power of ten.
    digits = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]
    place = lambda i: F.element_at(F.array(*map(F.lit, digits[i])), (F.floor(n / 10**i) % 10 + 1).cast("int"))
    return F.concat(*[place(i) for i in (3, 2, 1, 0)])


def padded_binary(n: Column, digits: int) -> Column:
    """A number in base 2, with zeros in front up to so many digits; a longer one stays whole."""
    bits = F.bin(n)
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(digits) - F.char_length(bits), F.lit(0))), bits)


def filled_lines(tree: Tree, boxes: DataFrame, color: str) -> DataFrame:
    """A line of TikZ that fills each of the boxes (level, ix, iy), such as one box's part of an interaction list."""
    r = rectangles(tree, leaves_only=False).join(boxes.select("level", "ix", "iy"), ["level", "ix", "iy"], "left_semi")
    return r.select("level", "ix", "iy", F.format_string(f"\\fill[{color}] (%.5f,%.5f) rectangle (%.5f,%.5f);", "x0", "y0", "x1", "y1").alias("line"))
