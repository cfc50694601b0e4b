"""NumPy kernels of dislocations in an elastic half-space, for blocks of observations and patches at once.

Surface displacement of planar polygons
---------------------------------------
By reciprocity, component k of the displacement at a surface point is the integral over the patch of slip_i n_j sigma_ij, the
stress that a unit force at that point in direction k causes (Boussinesq for vertical, Cerruti for horizontal forces). With
x the vector from the point to the patch (z down), R its length, L = ln(R + z) and M = (x, y) / (R + z), that stress is
1 / (2 pi) times

    -3 x_k x_i x_j / R^5 + (1 - 2 nu) S_ij,    S = the Airy stress of L (vertical force) or of -M_k (horizontal force).

Both parts are integrated in closed form over any planar polygon. Integration by parts in the plane turns the first into the
solid angle and integrals of R^-3 along the edges; the second is a derivative along the patch's strike, so it is an integral of
the gradient of L or M along the edges, whose perpendicular parts follow from R, L and M being harmonic relatives. Nothing
depends on an edge's side or on a choice of branches, so there are no artefact lines; only points on an edge itself have no value.
References: J. Boussinesq 1885, V. Cerruti 1882 (in A. Love, Mathematical Theory of Elasticity); A. van Oosterom and J. Strackee 1983.

Displacement and strain below the surface
-----------------------------------------
Rectangles by Y. Okada, Internal deformation due to shear and tensile faults in a half-space, BSSA 82 (1992), 1018-1040, table 6.
Derivatives are taken with an imaginary step, so they are as exact as the displacements.
"""

from __future__ import annotations

import numpy as np

#: Slip components: left-lateral, thrust and opening, of the upper side against the lower one.
SLIPS = ("strike", "dip", "opening")
#: Edges whose horizontal part is under this share of their length are taken as vertical.
_UPRIGHT = 1e-5


def rectangle_corners(x: np.ndarray, y: np.ndarray, depth: np.ndarray, strike: np.ndarray, dip: np.ndarray, length: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(patches, 4, 3) corners of rectangles from the centre of their upper edge; they dip to the right of their strike (degrees)."""
    s, d = np.radians(strike), np.radians(dip)
    along = np.stack([np.sin(s), np.cos(s), 0 * s], -1) * (length / 2)[:, None]
    down = np.stack([np.cos(d) * np.cos(s), -np.cos(d) * np.sin(s), np.sin(d)], -1) * width[:, None]
    top = np.stack([x, y, depth], -1)
    return np.stack([top - along, top + along, top + along + down, top - along + down], 1)


def compound_corners(x: np.ndarray, y: np.ndarray, depth: np.ndarray, turns: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(sources, 3, 4, 3) corners of three rectangles at right angles through a centre: half axes (sources, 3), turned about east, north and up.

    Turns are (sources, 3) degrees counterclockwise, the one about east first. The k-th rectangle lies across the k-th axis.
    """
    t = np.radians(turns)
    (ca, cb, cc), (sa, sb, sc) = np.cos(t).T, np.sin(t).T
    zero, one = 0 * ca, 0 * ca + 1
    matrix = lambda *rows: np.moveaxis(np.array(rows), -1, 0)
    about = matrix([cc, -sc, zero], [sc, cc, zero], [zero, zero, one]) @ matrix([cb, zero, sb], [zero, one, zero], [-sb, zero, cb]) @ matrix([one, zero, zero], [zero, ca, -sa], [zero, sa, ca])
    half = np.swapaxes(about, 1, 2) * axes[:, :, None] * np.array([1, 1, -1])  # as x, y and depth
    center = np.stack([x, y, depth], -1)[:, None, :]
    out = []
    for k in range(3):
        p, q = half[:, (k + 1) % 3], half[:, (k + 2) % 3]
        out.append(center + np.stack([-p - q, p - q, p + q, -p + q], 1))
    return np.stack(out, 1)


def slip_vectors(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The patches' normals as their corners turn, and (patches, 3 slips, 3) vectors of unit slip of the side above."""
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    n = n / np.linalg.norm(n, axis=1, keepdims=True)
    above = np.where(n[:, 2:] > 0, -n, n)  # z is down
    flat = np.hypot(above[:, 0], above[:, 1])
    level = flat < 1e-12
    # the fault dips to the right of its strike, so the strike is the upward normal's horizontal part turned to the left
    strike = np.stack([np.where(level, 0.0, -above[:, 1] / np.where(level, 1, flat)), np.where(level, 1.0, above[:, 0] / np.where(level, 1, flat)), 0 * flat], -1)
    updip = np.cross(above, strike)
    updip = np.where(updip[:, 2:] > 0, -updip, updip)
    # on a level patch the way up has no depth part: the fault dips to the right, so up is to the left
    updip[level] = [-1.0, 0.0, 0.0]
    return n, np.stack([strike, updip, above], 1)


def rectangle_slips(strike: np.ndarray, dip: np.ndarray) -> np.ndarray:
    """(patches, 3 slips, 3) vectors of unit slip of the side above, for given angles (degrees)."""
    s, d = np.radians(strike), np.radians(dip)
    along = np.stack([np.sin(s), np.cos(s), 0 * s], -1)
    up = np.stack([-np.cos(d) * np.cos(s), np.cos(d) * np.sin(s), -np.sin(d)], -1)
    above = np.stack([np.sin(d) * np.cos(s), -np.sin(d) * np.sin(s), -np.cos(d)], -1)
    return np.stack([along, up, above], 1)


def _ends(t1: np.ndarray, r1: np.ndarray, t2: np.ndarray, r2: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integrals of 1/R and 1/R^3 along a straight line from t1 to t2, without cancellation beyond its ends."""
    same = t1 * t2 > 0
    far1, far2 = r1 + np.abs(t1), r2 + np.abs(t2)
    safe = np.where(same, 1.0, square)
    log = np.where(same, np.sign(t2) * np.log(far2 / far1), np.sign(t2) * np.log(far2 * far1 / safe))
    log = np.where((t1 == 0) & (t2 == 0), 0.0, np.where(~same & (t2 == 0), np.log(far1 / np.sqrt(safe)), np.where(~same & (t1 == 0), np.sign(t2) * np.log(far2 / np.sqrt(safe)), log)))
    cube = np.where(same, np.sign(t2) * (1 / (r1 * far1) - 1 / (r2 * far2)), (t2 / r2 - t1 / r1) / safe)
    return log, cube


def polygon_surface(x: np.ndarray, y: np.ndarray, corners: np.ndarray, poisson: float = 0.25, slips: np.ndarray | None = None) -> np.ndarray:
    """(observations, patches, 3 slips, 3) displacement east, north and up at surface points, for unit slips.

    ``corners`` is (patches, 3 or more, 3) of x, y and depth (0 or more), each patch plane and convex. ``slips`` are the unit
    slips' vectors (east, north, down) where the corners' own strike shall not count (level patches).
    """
    sides = corners.shape[1]
    n, own = slip_vectors(corners)
    slips = own if slips is None else slips
    with np.errstate(divide="ignore", invalid="ignore"):
        v = corners[None] - np.stack([x, y, 0 * x], -1)[:, None, None, :]
        r = np.sqrt((v * v).sum(-1))
        h = (v[:, :, 0] * n).sum(-1)
        omega = np.zeros(h.shape)
        for k in range(1, sides - 1):
            a, b, c = v[:, :, 0], v[:, :, k], v[:, :, k + 1]
            ra, rb, rc = r[:, :, 0], r[:, :, k], r[:, :, k + 1]
            triple = (a * np.cross(b, c)).sum(-1)
            omega += 2 * np.arctan2(triple, ra * rb * rc + (a * b).sum(-1) * rc + (b * c).sum(-1) * ra + (c * a).sum(-1) * rb)
        # A_ki = 3 h integral of x_k x_i / R^5, times each slip
        out = omega[:, :, None, None] * slips[None]
        loose = 1 - 2 * poisson
        soft = np.zeros(out.shape)
        for k in range(sides):
            one, two = corners[:, k], corners[:, (k + 1) % sides]
            e = two - one
            e = e / np.linalg.norm(e, axis=1, keepdims=True)
            outward = np.cross(e, n)
            va, vb, ra, rb = v[:, :, k], v[:, :, (k + 1) % sides], r[:, :, k], r[:, :, (k + 1) % sides]
            ta, tb = (va * e).sum(-1), (vb * e).sum(-1)
            foot = va - ta[:, :, None] * e
            square = (foot * foot).sum(-1)
            log, cube = _ends(ta, ra, tb, rb, square)
            line = foot * cube[:, :, None] + e * (1 / ra - 1 / rb)[:, :, None]  # integral of x / R^3
            beside = (va * outward).sum(-1)
            m_s, n_s = np.einsum("pj,psj->ps", outward, slips), np.einsum("pj,psj->ps", n, slips)
            part = line[:, :, None, :] * m_s[None, :, :, None]
            part += (h * cube)[:, :, None, None] * (outward[:, None, :] * n_s[:, :, None])[None]
            part -= (beside * cube)[:, :, None, None] * (n[:, None, :] * n_s[:, :, None])[None]
            out -= h[:, :, None, None] * part
            soft += _edge_gradients(va, vb, ra, rb, ta, tb, square, log, e, slips) * (n[:, 0] * outward[:, 1] - n[:, 1] * outward[:, 0])[None, :, None, None]
        out = (loose * soft - out) / (2 * np.pi)
    # slips are of the side above (a vertical patch: to the right of its strike), the integral's of the side that the normal points to
    out *= np.where((n * slips[:, 2]).sum(1) < 0, -1.0, 1.0)[None, :, None, None]
    out[..., 2] *= -1
    return out


def _edge_gradients(va: np.ndarray, vb: np.ndarray, ra: np.ndarray, rb: np.ndarray, ta: np.ndarray, tb: np.ndarray, square: np.ndarray, log: np.ndarray, e: np.ndarray, slips: np.ndarray) -> np.ndarray:
    """(observations, patches, slips, 3): integrals along an edge of the turned slips' derivative of -M_x, -M_y and L.

    Along the edge's horizontal direction a derivative is the total one less the vertical one; across it, L's is an arc
    tangent of R + the place along the edge, and M's follow from its sum of second derivatives being 1/R.
    """
    turned = np.stack([-slips[..., 1], slips[..., 0]], -1)
    flat, ez = np.hypot(e[:, 0], e[:, 1]), e[:, 2]
    upright, down = flat < _UPRIGHT, np.where(ez < 0, -1.0, 1.0)
    eh = np.where(upright, 1.0, flat)
    way = np.where(upright[:, None], [1.0, 0.0], e[:, :2] / eh[:, None])
    side = np.stack([-way[:, 1], way[:, 0]], -1)
    c = (va[..., :2] * side).sum(-1)
    pa, pb = ra + va[..., 2], rb + vb[..., 2]
    ea, eb = (va[..., :2] * way).sum(-1), (vb[..., :2] * way).sum(-1)

    def angle(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        t = down * t
        s = np.where(t < 0, square / (r - t), r + t)
        return np.arctan2(s * (1 + np.abs(ez)) + va[..., 2] - ta * ez, np.abs(c) * eh)

    lq = np.sign(c) * down * 2 / eh * (angle(rb, tb) - angle(ra, ta))
    le = (np.log(pb / pa) - ez * log) / eh
    jee = (eb / pb - ea / pa + ez * le) / eh
    jeq = (c / pb - c / pa + ez * lq) / eh
    jqq = log - jee
    if upright.any():  # the horizontal place is constant, and the step along the edge is one in depth
        xa, ya = (va[..., 0] + vb[..., 0]) / 2, (va[..., 1] + vb[..., 1]) / 2
        line = down * (1 / pb - 1 / pa)
        cube = down * (1 / pb**2 - 1 / pa**2) / 2
        over = down * np.log(pb / pa) / 2 - (xa * xa + ya * ya) * cube / 2
        le, lq = np.where(upright, -xa * line, le), np.where(upright, -ya * line, lq)
        jee, jeq, jqq = np.where(upright, over + xa * xa * cube, jee), np.where(upright, xa * ya * cube, jeq), np.where(upright, over + ya * ya * cube, jqq)
    be, bq = (np.einsum("psj,pj->ps", turned, u)[None] for u in (way, side))
    jee, jeq, jqq, le, lq = (i[:, :, None] for i in (jee, jeq, jqq, le, lq))
    me, mq = be * jee + bq * jeq, be * jeq + bq * jqq
    east, north = (me * way[None, :, None, k] + mq * side[None, :, None, k] for k in (0, 1))
    return np.stack([-east, -north, be * le + bq * lq], -1)


def rectangle_inside(x: np.ndarray, y: np.ndarray, depth: np.ndarray, patch: np.ndarray, poisson: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Displacement (n, 3 slips, 3) and its gradient (n, 3 slips, 3 components, 3 directions), east, north and up.

    One patch at n points at any depth; ``patch`` is x, y and depth of the upper edge's centre, strike, dip, length and width.
    """
    px, py, top, strike, dip, length, width = map(float, patch)
    s, d = np.radians(strike), np.radians(dip)
    de, dn = x - px, y - py
    place = (de * np.sin(s) + dn * np.cos(s) + length / 2, -de * np.cos(s) + dn * np.sin(s) + width * np.cos(d), -np.asarray(depth, float) + 0 * x)
    c = top + width * np.sin(d)
    step = 1e-30
    whole = _okada(*place, c, d, length, width, poisson)
    slopes = []
    for k in range(3):
        moved = [p + 0j for p in place]
        moved[k] = moved[k] + 1j * step
        slopes.append(_okada(*moved, c, d, length, width, poisson).imag / step)
    turn = np.array([[np.sin(s), -np.cos(s), 0.0], [np.cos(s), np.sin(s), 0.0], [0.0, 0.0, 1.0]])
    return whole @ turn.T, np.einsum("ia,nsab,jb->nsij", turn, np.stack(slopes, -1), turn)


def _okada(x: np.ndarray, y: np.ndarray, z: np.ndarray, c: float, dip: float, length: float, width: float, poisson: float) -> np.ndarray:
    """(n, slips, 3) displacement along x, y and up: lower edge at depth ``c`` along +x, rising towards +y; z is 0 or less."""
    sd, cd = np.sin(dip), np.cos(dip)
    cd = 0.0 if abs(cd) < 1e-9 else cd
    alpha = 1 / (2 * (1 - poisson))
    lost = (1 - alpha) / alpha

    def corners(z: np.ndarray) -> list:
        d = c - z
        p, q = y * cd + d * sd, y * sd - d * cd
        return [(sign, x - dx, p - dp, q) for sign, dx, dp in ((1, 0, 0), (-1, 0, width), (-1, length, 0), (1, length, width))]

    def terms(xi: np.ndarray, eta: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
        r = np.sqrt(xi * xi + eta * eta + q * q)
        by, bx = r + eta, r + xi
        flat_y, flat_x = by.real < 1e-12 * r.real, bx.real < 1e-12 * r.real
        inv_y, inv_x = (np.where(f, 0, 1 / np.where(f, 1, b)) for f, b in ((flat_y, by), (flat_x, bx)))
        zero = np.abs(q.real) < 1e-12
        return {
            "r": r, "x11": inv_x / r, "x32": (2 * r + xi) * inv_x**2 / r**3, "y11": inv_y / r, "y32": (2 * r + eta) * inv_y**2 / r**3,
            "log_y": np.where(flat_y, -np.log(np.where(flat_y, r - eta, 1)), np.log(np.where(flat_y, 1, by))), "log_x": np.where(flat_x, -np.log(np.where(flat_x, r - xi, 1)), np.log(np.where(flat_x, 1, bx))),
            "theta": np.where(zero, 0, np.arctan(xi * eta / (np.where(zero, 1, q) * r))),
        }

    def infinite(xi: np.ndarray, eta: np.ndarray, q: np.ndarray) -> list[list]:
        t = terms(xi, eta, q)
        half, rest, theta = alpha / 2, (1 - alpha) / 2, t["theta"] / 2
        return [
            [theta + half * xi * q * t["y11"], half * q / t["r"], rest * t["log_y"] - half * q * q * t["y11"]],
            [half * q / t["r"], theta + half * eta * q * t["x11"], rest * t["log_x"] - half * q * q * t["x11"]],
            [-rest * t["log_y"] - half * q * q * t["y11"], -rest * t["log_x"] - half * q * q * t["x11"], theta - half * q * (eta * t["x11"] + xi * t["y11"])],
        ]

    def surface(xi: np.ndarray, eta: np.ndarray, q: np.ndarray) -> list[list]:
        t = terms(xi, eta, q)
        r, yt, dt = t["r"], eta * cd + q * sd, eta * sd - q * cd
        rd = r + dt
        if cd:
            far = np.sqrt(xi * xi + q * q)
            none = np.abs(xi.real) < 1e-12
            turn = np.where(none, 0, np.arctan((eta * (far + q * cd) + far * (r + far) * sd) / (np.where(none, 1, xi) * (r + far) * cd)))
            i4 = sd / cd * xi / rd + 2 / cd**2 * turn
            i3 = yt / (cd * rd) - (t["log_y"] - sd * np.log(rd)) / cd**2
        else:
            i4 = xi * yt / rd**2 / 2
            i3 = (eta / rd + yt * q / rd**2 - t["log_y"]) / 2
        i1, i2 = -xi / rd * cd - i4 * sd, np.log(rd) + i3 * sd
        theta, x11, y11 = t["theta"], t["x11"], t["y11"]
        return [
            [-xi * q * y11 - theta - lost * i1 * sd, -q / r + lost * yt / rd * sd, q * q * y11 - lost * i2 * sd],
            [-q / r + lost * i3 * sd * cd, -eta * q * x11 - theta - lost * xi / rd * sd * cd, q * q * x11 + lost * i4 * sd * cd],
            [q * q * y11 - lost * i3 * sd * sd, q * q * x11 + lost * xi / rd * sd * sd, q * (eta * x11 + xi * y11) - theta - lost * i4 * sd * sd],
        ]

    def deep(xi: np.ndarray, eta: np.ndarray, q: np.ndarray) -> list[list]:
        t = terms(xi, eta, q)
        r, x11, x32, y11, y32 = (t[k] for k in ("r", "x11", "x32", "y11", "y32"))
        yt, dt, h = eta * cd + q * sd, eta * sd - q * cd, q * cd - z
        ct, z32 = dt + z, sd / r**3 - h * y32
        keep = 1 - alpha
        return [
            [keep * xi * y11 * cd - alpha * xi * q * z32, keep * (cd / r + 2 * q * y11 * sd) - alpha * ct * q / r**3, keep * q * y11 * cd - alpha * (ct * eta / r**3 - z * y11 + xi * xi * z32)],
            [keep * cd / r - q * y11 * sd - alpha * ct * q / r**3, keep * yt * x11 - alpha * ct * eta * q * x32, -dt * x11 - xi * y11 * sd - alpha * ct * (x11 - q * q * x32)],
            [-keep * (sd / r + q * y11 * cd) - alpha * (z * y11 - q * q * z32), keep * 2 * xi * y11 * sd + dt * x11 - alpha * ct * (x11 - q * q * x32), keep * (yt * x11 + xi * y11 * cd) + alpha * q * (ct * eta * x32 + xi * z32)],
        ]

    out = np.zeros((len(x), 3, 3), np.result_type(x, y, z, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        for real, image in zip(corners(z), corners(-z), strict=True):
            sign = real[0]
            here, mirrored, top, low = infinite(*real[1:]), infinite(*image[1:]), surface(*real[1:]), deep(*real[1:])
            for k in range(3):
                f = [here[k][j] - mirrored[k][j] + top[k][j] for j in range(3)]
                g = [z * low[k][j] for j in range(3)]
                out[:, k, 0] += sign * (f[0] + g[0])
                out[:, k, 1] += sign * ((f[1] + g[1]) * cd - (f[2] + g[2]) * sd)
                out[:, k, 2] += sign * ((f[1] - g[1]) * sd + (f[2] - g[2]) * cd)
    return out / (2 * np.pi)
