"""SQL twins of the common readings, as CTEs for DuckDB."""

TILE = """CASE WHEN length(upper(trim({t}))) = 6 AND starts_with(upper(trim({t})), 'T') THEN substr(upper(trim({t})), 2) ELSE upper(trim({t})) END"""

KEY = r"""trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g'))"""

CATEGORY = f"""coalesce((SELECT min(l.lc_code) FROM legend l WHERE l.lc_code = {{r}}.class_id), (SELECT min(l.lc_code) FROM legend l WHERE l.internal_code = {{r}}.class_id),
  (SELECT min(l.lc_code) FROM legend l WHERE {KEY.format(c="l.description")} = {KEY.format(c="{r}.class")}))"""

DATASET = f"""d AS (SELECT r.row_id, r.split, r.source, {CATEGORY.format(r="r")} AS category,
    g.ul_x + r.pixel_m * ((CASE WHEN r.axis_order = 'yx' THEN r.y ELSE r.x END) + 0.5) AS px,
    g.ul_y - r.pixel_m * ((CASE WHEN r.axis_order = 'yx' THEN r.x ELSE r.y END) + 0.5) AS py
  FROM dataset r LEFT JOIN tile_geometry g ON g.tile = {TILE.format(t="r.tile")})"""

POINTS = f"""p AS (SELECT DISTINCT r.point_id, r.geom.x AS x, r.geom.y AS y, {CATEGORY.format(r="r")} AS category FROM points_df r
    WHERE r.geom.x IS NOT NULL AND r.geom.y IS NOT NULL AND NOT (r.geom.x = 0 AND r.geom.y = 0))"""

MONTH = r"""coalesce(month(time), try_cast(regexp_extract(file_name, '_0?([0-9]{1,2})\.[A-Za-z]+$', 1) AS INT))"""
