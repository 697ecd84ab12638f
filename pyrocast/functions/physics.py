"""Scalar functions on weather, geography and fire as column expressions.

Each takes SQL expressions as strings and gives one, so that they nest and stay in generated code.
"""

from __future__ import annotations

# The earth's mean radius in km, and the bounding box of the contiguous states.
EARTH_KM = "6371.0088e0"
BBOX = {"lat": (24.396308, 49.384358), "lon": (-125.0, -66.93457)}

# Fuels as (sav, packing ratio, net fuel load, moisture of extinction, bed depth).
FUELS = {
    "grass": (2100, 0.00306, 0.294, 0.15, 3),
    "shrub": (1672, 0.01198, 0.239, 0.3, 1.2),
    "forest": (1716, 0.04878, 0.0459, 0.2, 0.1),
    "forest_supp": (1500, 0.02224, 0.689, 0.25, 0.5),
}
# Vegetation classes of the land-cover map, in the same order of figures; what can't burn has none.
VEGETATION = {
    "grasslands": (2100, 0.00306, 0.294, 0.15, 3.0),
    "closed_shrublands": (1672, 0.01198, 0.239, 0.3, 1.2),
    "open_shrublands": (1500, 0.01, 0.2, 0.3, 1.0),
    "evergreen_needleleaf": (1716, 0.04878, 0.0459, 0.2, 0.1),
    "deciduous_needleleaf": (1650, 0.045, 0.04, 0.2, 0.1),
    "evergreen_broadleaf": (1500, 0.035, 0.06, 0.25, 0.12),
    "deciduous_broadleaf": (1400, 0.03, 0.05, 0.25, 0.1),
    "mixed_forest": (1608, 0.042, 0.05295, 0.22, 0.11),
    "woody_savannas": (1400, 0.008, 0.18, 0.3, 0.8),
    "savannas": (1450, 0.0085, 0.17, 0.25, 0.7),
    "croplands": (1200, 0.015, 0.2, 0.3, 0.5),
    "cropland_mosaic": (1300, 0.012, 0.18, 0.25, 0.6),
    "permanent_wetlands": (800, 0.007, 0.12, 0.5, 0.5),
    "barren": (600, 0.002, 0.01, 0.1, 0.05),
    "urban_built": None,
    "snow_ice": None,
    "water": None,
}
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def sat_vp(celsius: str) -> str:
    """Saturation vapour pressure in kPa."""
    return f"(0.6108 * exp(17.2693882 * ({celsius}) / (({celsius}) + 237.3)))"


def relative_humidity(t_kelvin: str, mean_kelvin: str, vpd: str) -> str:
    """Percent, 0 to 100, at a temperature, for the vapour that a deficit in kPa leaves at the day's mean."""
    vapour = f"({sat_vp(f'({mean_kelvin}) - 273.15')} - ({vpd}))"
    return f"(100 * least(1.0, greatest(0.0, {vapour} / {sat_vp(f'({t_kelvin}) - 273.15')})))"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"(2 * {EARTH_KM} * asin(sqrt(least(1.0, {a}))))"


def offset_point(lat: str, lon: str, km: str, bearing: str) -> tuple[str, str]:
    """(lat, lon) of the point so far away in that direction, on a sphere."""
    d, b = f"(({km}) / {EARTH_KM})", f"radians({bearing})"
    sin_lat = f"(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos({b}))"
    new_lat = f"degrees(asin({sin_lat}))"
    new_lon = f"(({lon}) + degrees(atan2(sin({b}) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * {sin_lat})))"
    return new_lat, new_lon


def geodesic_point(lat: str, lon: str, km: str, bearing: str, a: float = 6378.137, f: float = 1 / 298.257223563) -> tuple[str, str]:
    """(lat, lon) of the point so far away in that direction on an ellipsoid, by default WGS 84: a in km, f its flattening.

    Vincenty's direct solution. The arc's length is refined in eight steps, each of which gains some three
    digits; what is bound by a one-step transform is computed once.
    """
    b = a * (1 - f)
    sigma = """aggregate(sequence(1, 8), p.s0, (s, i) -> p.s0 + p.B * sin(s) * (cos(2 * p.s1 + s) + p.B / 4 * (
        cos(s) * (2 * pow(cos(2 * p.s1 + s), 2) - 1) - p.B / 6 * cos(2 * p.s1 + s) * (4 * pow(sin(s), 2) - 3) * (4 * pow(cos(2 * p.s1 + s), 2) - 3))))"""
    bind = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    u = f"named_struct('sin', sin(atan({1 - f!r} * tan(radians({lat})))), 'cos', cos(atan({1 - f!r} * tan(radians({lat})))), 'bs', sin(radians({bearing})), 'bc', cos(radians({bearing})))"
    # sa: sine of the geodesic's direction at the equator; u2: its second eccentricity; s1: the arc from the equator
    v = f"named_struct('sin', u.sin, 'cos', u.cos, 'bs', u.bs, 'bc', u.bc, 'sa', u.cos * u.bs, 'u2', (1 - pow(u.cos * u.bs, 2)) * {(a * a - b * b) / (b * b)!r}, 's1', atan2(u.sin / u.cos, u.bc))"
    big = "(1 + v.u2 / 16384 * (4096 + v.u2 * (-768 + v.u2 * (320 - 175 * v.u2))))"
    w = f"named_struct('sin', v.sin, 'cos', v.cos, 'bs', v.bs, 'bc', v.bc, 'sa', v.sa, 's1', v.s1, 'B', v.u2 / 1024 * (256 + v.u2 * (-128 + v.u2 * (74 - 47 * v.u2))), 's0', ({km}) / ({b!r} * {big}))"
    q = f"named_struct('p', p, 's', {sigma})"
    out = f"""named_struct(
        'lat', degrees(atan2(q.p.sin * cos(q.s) + q.p.cos * sin(q.s) * q.p.bc, {1 - f!r} * sqrt(pow(q.p.sa, 2) + pow(q.p.sin * sin(q.s) - q.p.cos * cos(q.s) * q.p.bc, 2)))),
        'lon', degrees(atan2(sin(q.s) * q.p.bs, q.p.cos * cos(q.s) - q.p.sin * sin(q.s) * q.p.bc) - {bind(f"{f / 16!r} * (1 - pow(q.p.sa, 2)) * (4 + {f!r} * (4 - 3 * (1 - pow(q.p.sa, 2))))", "c", f"(1 - c) * {f!r} * q.p.sa * (q.s + c * sin(q.s) * (cos(2 * q.p.s1 + q.s) + c * cos(q.s) * (2 * pow(cos(2 * q.p.s1 + q.s), 2) - 1)))")}))"""
    whole = bind(u, "u", bind(v, "v", bind(w, "p", bind(q, "q", out))))
    return f"({whole}).lat", f"(({lon}) + ({whole}).lon)"


def km_box(lat: str, lon: str, width_km: str, height_km: str) -> dict[str, str]:
    """south, north, west and east of a box around a point, by 111 km a degree."""
    w, h = f"(({width_km}) / (111.0e0 * cos(radians({lat}))) / 2)", f"(({height_km}) / 111.0e0 / 2)"
    return {"south": f"(({lat}) - {h})", "north": f"(({lat}) + {h})", "west": f"(({lon}) - {w})", "east": f"(({lon}) + {w})"}


def height_of(high: str, low: str, most: str) -> str:
    """Height of a pixel whose 16 bits are in two bytes, where all ones stand for `most`."""
    return f"((({high}) * 256 + ({low})) / 65535.0e0 * ({most}))"


def in_bbox(lat: str, lon: str) -> str:
    (a, b), (c, d) = BBOX["lat"], BBOX["lon"]
    return f"(({lat}) BETWEEN {a} AND {b} AND ({lon}) BETWEEN {c} AND {d})"


def month_angle(month: str) -> tuple[str, str]:
    angle = f"2 * pi() * (({month}) - 1) / 12"
    return f"sin({angle})", f"cos({angle})"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def compass(degrees: str) -> str:
    """Position (0 to 15) of a direction among COMPASS."""
    return f"(CAST(floor(({degrees}) / 22.5 + 0.5) AS BIGINT) % 16)"


def in_polygon(x: str, y: str, ring: list[tuple[float, float]]) -> str:
    """Whether a point lies inside a ring, by crossings of the ray to the right."""
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            parts.append(f"(CASE WHEN (({y}) < {y1}) <> (({y}) < {y2}) AND ({x}) < {x1} + (({y}) - ({y1})) * ({x2 - x1}) / ({y2 - y1}) THEN 1 ELSE 0 END)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def angle(x: str, y: str) -> str:
    """Of a vector from the positive x axis, in [0, 2 pi)."""
    return f"(CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2 * pi() ELSE atan2({y}, {x}) END)"


def direction_factor(dx: str, dy: str, wind_ft_min: str, max_direction: str) -> str:
    """Share of the largest spread rate in the direction (dx, dy): an ellipse, longer in more wind."""
    z = f"(1 + 0.25 * ({wind_ft_min}) / 88)"
    e = f"(sqrt({z} * {z} - 1) / {z})"
    return f"((1 - {e}) / (1 - {e} * cos(abs({angle(dx, dy)} - ({max_direction})))))"


def spread_columns() -> list[tuple[str, str]]:
    """(name, expression), each on those before it, up to `spread_rate` in feet a minute.

    Expected columns: dx, dy (cells from source to target), dz (feet up), moisture, cell_size, wind
    (miles an hour), wind_dir (degrees from north), and the fuel's sav, beta, load, mx, depth.
    Reaction intensity over heat sink, then slope and wind as vectors, then the ellipse.
    """
    return [
        ("beta_rel", "beta / (3.348 * pow(sav, -0.8189))"),
        ("fa", "133 * pow(sav, -0.7913)"),
        ("fb", "0.02526 * pow(sav, 0.54)"),
        ("fc", "7.47 * exp(-0.133 * pow(sav, 0.55))"),
        ("fe", "0.715 * (-0.000359 * sav)"),
        ("velocity", "pow(sav, 1.5) / (495 + 0.0594 * pow(sav, 1.5)) * pow(beta_rel, fa) * exp(fa * (1 - beta_rel))"),
        ("mr", "moisture / mx"),
        ("damping", "(1 - 2.59 * mr + 5.11 * mr * mr - 3.52 * mr * mr * mr) * 0.174 * pow(0.01, -0.19)"),
        ("flux", "exp((0.792 + 0.681 * sqrt(sav)) * (beta + 0.1)) / (192 + 0.2595 * sav)"),
        ("sink", "load / (1 - 0.0555) / depth * exp(-138 / sav) * (250 + 1116 * moisture)"),
        ("r0", "velocity * load * 8000 * damping * flux / sink"),
        ("wind_push", "r0 * fc * pow(wind * 88, fb) * pow(beta_rel, -fe)"),
        ("run_ft", "sqrt(dx * dx + dy * dy) * cell_size"),
        ("slope_push", "r0 * 5.275 * pow(beta, -0.3) * pow(dz / run_ft, 2)"),
        ("up", "CASE WHEN dz >= 0 THEN 1 ELSE -1 END"),
        ("vx", "wind_push * -sin(radians(wind_dir)) + slope_push * up * dx / sqrt(dx * dx + dy * dy)"),
        ("vy", "wind_push * -cos(radians(wind_dir)) + slope_push * up * dy / sqrt(dx * dx + dy * dy)"),
        ("rh", "r0 + sqrt(vx * vx + vy * vy)"),
        ("effective", "pow((rh / r0 - 1) / (fc * pow(beta_rel, -fe)), 1 / fb)"),
        ("spread_rate", f"rh * {direction_factor('dx', 'dy', 'effective', angle('vx', 'vy'))}"),
    ]
