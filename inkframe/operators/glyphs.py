"""Text to pixels: a small outline font of thick strokes, filled by scan lines, with the covered share of each pixel.

A glyph is drawn on a grid four wide and six high, the base line at 6; lower-case letters are their capitals at a smaller
size, letters with marks their plain ones, and any other character is a box. Each stroke is a rectangle about its line, of
the font's weight, half of which it goes on beyond both ends. A pixel's coverage is the share of its scan lines that
lies within any stroke.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Strokes of each character: lines through grid points (column, row), set apart by blanks.
STROKES = {
    "A": "062046 1434", "B": "060030413303 3344453606", "C": "4130100105163645", "D": "06003041453606", "E": "40000646 0333", "F": "400006 0333", "G": "41301001051636454323", "H": "0006 4046 0343",
    "I": "1030 2026 1636", "J": "4045361605", "K": "0006 400346", "L": "000646", "M": "0600244046", "N": "06004640", "O": "103041453616050110", "P": "06003041423303", "Q": "103041453616050110 2446",
    "R": "06003041423303 2346", "S": "413010010213334445361605", "T": "0040 2026", "U": "000516364540", "V": "002640", "W": "0016223640", "X": "0046 4006", "Y": "002340 2326", "Z": "00400646",
    "0": "103041453616050110 4105", "1": "112026 1636", "2": "011030414206 0646", "3": "00402243453616", "4": "36300444", "5": "4000023243453616", "6": "302001051636454403", "7": "004016",
    "8": "103041423313020110 1304051636454433", "9": "163645413010010213334342", ".": "2526", ",": "2516", ":": "2122 2526", ";": "2122 2516", "!": "2024 2626", "?": "011030414224 2626", "'": "2021",
    '"': "1011 3031", "-": "1333", "_": "0646", "+": "0343 2125", "=": "0242 0444", "*": "0343 1135 3115", "/": "0640", "\\": "0046", "|": "2026", "(": "30212536", ")": "10212516", "[": "30202636",
    "]": "10202616", "{": "302122132425 2536", "}": "102122332425 2516", "<": "410345", ">": "014305", "#": "1016 3036 0242 0444", "$": "413010010213334445361605 2026", "%": "0640 0001 4546",
    "&": "461110203105162644", "@": "322224344341301001051646", "^": "122032", "~": "03123342", "`": "1021",
}
#: The box of all others; the grid's height and a character's width in it; a small letter's size; a stroke's weight; all but the last in grid units.
OTHER, HEIGHT, ADVANCE, SMALL, WEIGHT = "0040460600", 8.0, 6.0, 0.75, 0.7
#: Scan lines of a pixel, and samples along one.
LINES = 8


@functools.cache
def strokes(character: str) -> np.ndarray:
    """Line pieces (n, x0, y0, x1, y1) of a character in grid units, from its left upper corner on; none for white space."""
    if character.isspace():
        return np.zeros((0, 4))
    plain = unicodedata.normalize("NFD", character)[0]
    size = SMALL if plain.upper() != plain and plain.upper() in STROKES else 1.0
    out = []
    for line in STROKES.get(plain if plain in STROKES else plain.upper(), OTHER).split():
        p = np.array([(int(line[k]), int(line[k + 1])) for k in range(0, len(line), 2)], float)
        p[:, 0], p[:, 1] = p[:, 0] * size + 0.5, 6 - (6 - p[:, 1]) * size + 0.5
        out += [(*a, *b) for a, b in zip(p[:-1], p[1:], strict=True)] or [(*p[0], *p[0])]
    return np.array(out)


def outlines(text: str, x: float, y: float, font_px: float) -> np.ndarray:
    """Corners (n, 4, 2) of the rectangles that draw a text from its left upper corner (x, y)."""
    k = font_px / HEIGHT
    pieces = [strokes(c) + np.array([ADVANCE * n, 0, ADVANCE * n, 0]) for n, c in enumerate(text)]
    p = np.concatenate([np.zeros((0, 4)), *pieces]) * k + np.array([x, y, x, y])
    a, b = p[:, :2], p[:, 2:]
    along = b - a
    length = np.hypot(*along.T)[:, None]
    along = np.where(length > 0, along / np.maximum(length, 1e-12), (1.0, 0.0)) * WEIGHT * k / 2
    across = along[:, ::-1] * (-1, 1)
    return np.stack([a - along - across, b + along - across, b + along + across, a - along + across], 1)


def coverage(shapes: np.ndarray, width: int, height: int) -> tuple[int, int, np.ndarray]:
    """Left, top and covered shares (rows, columns) of the pixels of an image that convex shapes (n, corners, 2) touch."""
    if not len(shapes):
        return 0, 0, np.zeros((0, 0))
    low, high = np.floor(shapes.min((0, 1))), np.ceil(shapes.max((0, 1)))
    left, top, right, bottom = max(0, int(low[0])), max(0, int(low[1])), min(width, int(high[0])), min(height, int(high[1]))
    if right <= left or bottom <= top:
        return 0, 0, np.zeros((0, 0))
    rows, columns = (bottom - top) * LINES, (right - left) * LINES
    hit = np.zeros((rows, columns), bool)
    for corners in shapes:
        own = (corners - (left, top)) * LINES
        first, last = max(0, int(np.ceil(own[:, 1].min() - 0.5))), min(rows, int(np.ceil(own[:, 1].max() - 0.5)))
        if last <= first:
            continue
        at = np.arange(first, last) + 0.5
        a, b = own, np.roll(own, -1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = a[:, 0] + (at[:, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        within = (np.minimum(a[:, 1], b[:, 1]) <= at[:, None]) & (at[:, None] < np.maximum(a[:, 1], b[:, 1]))
        start = np.ceil(np.where(within, cross, np.inf).min(1) - 0.5)
        stop = np.ceil(np.where(within, cross, -np.inf).max(1) - 0.5)
        for row, s, e in zip(range(first, last), np.clip(start, 0, columns).astype(int).tolist(), np.clip(stop, 0, columns).astype(int).tolist(), strict=True):
            hit[row, s:e] = True
    return left, top, hit.reshape(bottom - top, LINES, right - left, LINES).mean((1, 3))


def paint(pixels: np.ndarray, text: str, x: float, y: float, font_px: float | None, colour=(17, 17, 17)) -> None:
    """Draws a text into pixels (height, width, RGBA) from its left upper corner on; without a font size nothing."""
    if not font_px or not np.isfinite((x, y, font_px)).all() or font_px <= 0:
        return
    h, w = pixels.shape[:2]
    # Characters right of the image, or left of it, are not drawn.
    step = ADVANCE * font_px / HEIGHT
    first = max(0, int(-x // step) - 1) if x < 0 else 0
    text = text[first : max(first, int((w - x) // step) + 2)]
    left, top, share = coverage(outlines(text, x + first * step, y, font_px), w, h)
    if share.size:
        part = pixels[top : top + share.shape[0], left : left + share.shape[1], :3]
        part[...] = np.floor(part * (1 - share[..., None]) + np.array(colour) * share[..., None] + 0.5)
