"""Plain Python counterparts of the areas, for comparison."""

import math


def inside(x, y, rings, box=None):
    if box is not None:
        x0, x1, y0, y1 = box
        return x0 <= x <= x1 and y0 <= y <= y1
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def star(corners, outer, inner):
    points = []
    for i in range(corners * 2):
        radius, angle = (inner if i % 2 else outer), math.pi * i / corners
        points.append((radius * math.cos(angle), radius * math.sin(angle)))
    return points + points[:1]


def wkt_of(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings) + ")"
