"""The steps of hydro over arrays of a tile with its halo, for plans.blocked: the same rules, cell by cell."""

from __future__ import annotations

import numpy as np

from catchwater.operators.hydro import Params
from catchwater.plans.blocked import Kernel, Tile


def _slopes(tile: Tile, v: np.ndarray) -> dict[str, np.ndarray]:
    """Positive slope towards each neighbour, 0 where there is none."""
    return {d: np.maximum(0.0, np.nan_to_num((v - tile.near(v, d)) / tile.meta.dx)) for d in tile.links}


def _norm(s: dict[str, np.ndarray]) -> np.ndarray:
    mx, my = np.maximum(s["l"], s["r"]), np.maximum(s["t"], s["b"])
    return np.sqrt(mx * mx + my * my)


def _shares(tile: Tile, v: np.ndarray) -> dict[str, np.ndarray]:
    """Each downward slope's part of all of a cell's, 0 at outlets and without data."""
    s = _slopes(tile, v)
    total = s["t"] + s["l"] + s["r"] + s["b"]
    off = tile.leave | tile.nodata | (total <= 0)
    return {d: np.where(off, 0.0, x / np.where(off, 1.0, total)) for d, x in s.items()}


def _capacity(h: np.ndarray, slope: np.ndarray, dx: float, manning: float) -> np.ndarray:
    return dx * np.power(h, 5.0 / 3.0) / manning * np.sqrt(slope)


def _depth(tile: Tile, q: np.ndarray, h: np.ndarray, norm: np.ndarray, p: Params, dt: float) -> np.ndarray:
    dx = tile.meta.dx
    balance = h + (q - _capacity(h, norm, dx, p.manning)) / (dx * dx) * dt
    return np.where(tile.leave, 0.0, np.where(tile.nodata, h, np.maximum(0.0, balance)))


def diffusive(p: Params, dt: float | None, keep_old: float, floor: float = 1e-6) -> Kernel:
    """hydro.diffusive_step; reaches two cells."""
    dt = p.dt if dt is None else dt

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, q = (tile.fields[c] for c in ("z", "h", "q"))
        source = p.rain * tile.meta.dx**2
        for _ in range(steps):
            zh = z + h
            got = tile.landed({d: q * w for d, w in _shares(tile, zh).items()})
            q = (1.0 - keep_old) * (source + got) + keep_old * q
            h = _depth(tile, q, h, np.maximum(_norm(_slopes(tile, zh)), floor), p, dt)
        return {"h": h, "q": q}

    return run


def depth(p: Params, dt: float | None) -> Kernel:
    """hydro.depth_step at constant q; the field `on`, where there is one, says which cells change."""
    dt = p.dt if dt is None else dt

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, q, on = (tile.fields.get(c) for c in ("z", "h", "q", "on"))
        for _ in range(steps):
            new = _depth(tile, q, h, _norm(_slopes(tile, z + h)), p, dt)
            h = new if on is None else np.where(on > 0, new, h)
        return {"h": h}

    return run


def analytic(p: Params, keep_old: float) -> Kernel:
    """hydro.analytic_depth."""

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, q, on = (tile.fields.get(c) for c in ("z", "h", "q", "on"))
        off, dx, bed = tile.leave | tile.nodata, tile.meta.dx, _slopes(tile, z)
        if on is not None:
            off = off | ~(on > 0)
        axes = lambda s: (np.maximum(s["l"], s["r"]), np.maximum(s["t"], s["b"]))
        for _ in range(steps):
            mx, my = axes(_slopes(tile, z + h))
            flat = (mx <= 0) & (my <= 0)
            if on is None:
                mx, my = np.where(flat, 1e-2, mx), np.where(flat, 1e-2, my)
            else:
                bx, by = axes(bed)
                none = (bx <= 0) & (by <= 0)
                mx, my = np.where(flat, np.where(none, 1e-3, bx), mx), np.where(flat, np.where(none, 1e-3, by), my)
            target = np.power(q * p.manning / (np.sqrt(np.sqrt(mx * mx + my * my)) * dx), 0.6)
            h = np.where(off, h, (1 - keep_old) * target + keep_old * h)
        return {"h": h}

    return run


def flux_diffusion(p: Params, omega: float) -> Kernel:
    """hydro.diffusion_flux_step with the field `source`."""

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, source = (tile.fields[c] for c in ("z", "h", "source"))
        dx, off = tile.meta.dx, tile.leave | tile.nodata
        for _ in range(steps):
            zh, flow = z + h, {}
            for d in ("r", "b"):
                s = (zh - tile.near(zh, d)) / dx
                flow[d] = np.nan_to_num(np.where(s >= 0, 1.0, -1.0) * np.power(np.fmax(h, tile.near(h, d)), 5 / 3) / p.manning * np.sqrt(np.abs(s)))
            net = np.nan_to_num(tile.near(flow["r"], "l")) - flow["r"] + np.nan_to_num(tile.near(flow["b"], "t")) - flow["b"]
            new = np.maximum(0.0, h + p.dt * (net / dx + source))
            h = np.where(off, h, (1 - omega) * h + omega * new)
        return {"h": h}

    return run


def _face(tile: Tile, side: str, q: np.ndarray, place: np.ndarray, n: int, z: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    dt, g, dx = p.dt_inertial, p.gravity, tile.meta.dx
    hn, zn = tile.near(h, side), tile.near(z, side)
    deep = np.maximum(z + h, zn + hn) - np.maximum(z, zn)
    slope = np.where(place == n - 1, p.edge_slope, np.where(place <= 2, -p.edge_slope, ((zn + hn) - (z + h)) / dx))
    new = (q - g * deep * dt * slope) / (1 + g * deep * dt * p.manning**2 * np.abs(q) / np.power(deep, 10.0 / 3.0))
    fastest = deep * np.sqrt(g * deep) * p.froude
    flow = np.where(np.abs(new) > fastest, np.where(new >= 0, 1.0, -1.0) * fastest, new)
    limited = np.where((flow > 0) & (flow * dt / dx > h / 4), h * dx / 5 / dt, np.where((flow < 0) & (np.abs(flow) * dt / dx > hn / 4), -hn * dx / 5 / dt, flow))
    inside = (tile.row != 0) & (tile.col != 0) & ~tile.nodata
    dry = ((h <= 0) & (hn <= 0)) | (deep <= p.least_flow)
    return np.where(~inside | np.isnan(hn), q, np.where(dry, 0.0, limited))


def inertial(p: Params) -> Kernel:
    """Rain by the field `rate`, hydro.inertial_faces, hydro.inertial_depth; reaches one cell."""

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, qx, qy, rate = (tile.fields[c] for c in ("z", "h", "qx", "qy", "rate"))
        dt, dx = p.dt_inertial, tile.meta.dx
        for _ in range(steps):
            h = np.where(tile.nodata, h, h + rate * dt)
            qy, qx = _face(tile, "t", qy, tile.row, tile.meta.ny, z, h, p), _face(tile, "l", qx, tile.col, tile.meta.nx, z, h, p)
            h = h + dt / dx * (np.nan_to_num(tile.near(qy, "b")) - qy + np.nan_to_num(tile.near(qx, "r")) - qx)
        return {"h": h, "qx": qx, "qy": qy}

    return run


def sweeps(omega: float, tile_of: int | None = None) -> Kernel:
    """hydro.sweep over a fixed surface zh, with the fields source and, where there are any, on and qapp.

    tile_of: links between tiles of that side carry the frozen qapp. The shares of zh reach one cell more than the sweeps.
    """

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        q, source, on, frozen = (tile.fields.get(c) for c in ("q", "source", "on", "qapp"))
        share = _shares(tile, tile.fields["zh"])
        if tile_of is not None:
            own = tile.row // tile_of * -(-tile.meta.nx // tile_of) + tile.col // tile_of
            same = {d: own == tile.near(own.astype(np.float64), d) for d in share}
        for _ in range(steps):
            sent = {d: (q if tile_of is None else np.where(same[d], q, frozen)) * w for d, w in share.items()}
            new = (1 - omega) * q + omega * (source + tile.landed(sent))
            q = new if on is None else np.where(on > 0, new, q)
        return {"q": q}

    return run


def velocity(p: Params, dt: float, omega: float) -> Kernel:
    """Face velocities ux (right) and uy (bottom) from bed and pressure, relaxed; then upwind fluxes of h ** (5/3), with the field source."""

    def run(tile: Tile, steps: int) -> dict[str, np.ndarray]:
        z, h, ux, uy, source = (tile.fields[c] for c in ("z", "h", "ux", "uy", "source"))
        dx, off = tile.meta.dx, tile.nodata

        def face(u: np.ndarray, d: str) -> np.ndarray:
            zn, hn = tile.near(z, d), tile.near(h, d)
            deep = np.maximum(0.0, np.maximum(z + h, zn + hn) - np.maximum(z, zn))
            push = np.power(deep, 1.5) / p.manning * ((z - zn) / dx + (h * h - hn * hn) / (2 * dx))
            new = (1 - omega) * u + omega * np.sign(push) * np.sqrt(np.abs(push))
            return np.where(off | np.isnan(hn) | ((h == 0) & (hn == 0)), u, new)

        for _ in range(steps):
            ux, uy = face(ux, "r"), face(uy, "b")
            v = np.where(h > 0, np.power(np.maximum(h, 0.0), 5 / 3), 0.0)
            net = np.zeros(h.shape)
            for d, u, sign in (("t", tile.near(uy, "t"), 1.0), ("l", tile.near(ux, "l"), 1.0), ("r", ux, -1.0), ("b", uy, -1.0)):
                vn = tile.near(v, d)
                ahead = np.where(sign * u < 0, v, vn)  # water leaves the cell where the flux is outward
                net += np.where(np.isnan(vn) | ((v == 0) & (vn == 0)), 0.0, sign * u * np.maximum(0.0, ahead))
            v = np.maximum(0.0, np.where(off, v, v + dt * (net + source)))
            h = np.power(v, 3 / 5)
        return {"h": h, "ux": ux, "uy": uy}

    return run
