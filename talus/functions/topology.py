"""Neighbour codes and their tables.

Codes run clockwise from the west: 1 W, 2 NW, 3 N, 4 NE, 5 E, 6 SE, 7 S, 8 SW;
0 is no direction. With four neighbours only the odd codes are used.
"""

from __future__ import annotations

import math

# Steps of each code, code 0 first.
DX = [0, -1, -1, 0, 1, 1, 1, 0, -1]
DY = [0, 0, -1, -1, -1, 0, 1, 1, 1]
INVERSE = [0, 5, 6, 7, 8, 1, 2, 3, 4]
DIAGONAL = [n > 0 and n % 2 == 0 for n in range(9)]
RUN = [1.0 if not d else math.sqrt(2.0) for d in DIAGONAL]
#: Codes of other tools by ours: powers of two clockwise from the east; 1..8 counter-clockwise from the east.
ARCGIS = {1: 16, 2: 32, 3: 64, 4: 128, 5: 1, 6: 2, 7: 4, 8: 8}
TAUDEM = {1: 5, 2: 4, 3: 3, 4: 2, 5: 1, 6: 8, 7: 7, 8: 6}


def codes(neighbours: int = 8) -> list[int]:
    if neighbours not in (4, 8):
        raise ValueError("a cell has 4 or 8 neighbours")
    return [1, 2, 3, 4, 5, 6, 7, 8] if neighbours == 8 else [1, 3, 5, 7]
