"""Macros that every session starts with, in the language itself."""

#: Fixed definitions.
PRELUDE = """
macro big(x) = x.area > 0.2;
macro small(x) = x.area < 0.05;
macro left(x) = x.x + x.w / 2 < 0.33;
macro right(x) = x.x + x.w / 2 > 0.67;
macro top(x) = x.y + x.h / 2 < 0.33;
macro bottom(x) = x.y + x.h / 2 > 0.67;
macro square(x) = abs(x.w / x.h - 1) < 0.1;
macro left_of(a, b) = a.x + a.w < b.x;
macro above(a, b) = a.y + a.h < b.y;
macro inside(a, b) = a.x > b.x && a.x + a.w < b.x + b.w && a.y > b.y && a.y + a.h < b.y + b.h;
macro warm(x) = x.attr.h > 5 && x.attr.h < 45;
macro cool(x) = x.attr.h > 180 && x.attr.h < 260;
macro bright(x) = x.attr.v > 0.75;
macro dark(x) = x.attr.v < 0.25;
macro smooth(x) = x.attr.lbp < 0.2;
macro rough(x) = x.attr.lbp > 0.6;
"""
