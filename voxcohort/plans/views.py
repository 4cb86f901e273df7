"""SQL views behind the oracles: the fixture shapes and the shared stages."""

from voxcohort.plans.registry import view

view("fx_clinical", """
  SELECT concat('C', cast(c_nationkey % 8 AS VARCHAR), '-', cast(c_custkey AS VARCHAR)) AS PatientID, c_custkey,
    cast(30 + c_custkey % 50 AS DOUBLE) AS Age, cast(c_custkey % 2 AS INT) AS Gender,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 1 ELSE 0 END AS HPV,
    CASE WHEN c_custkey % 37 = 0 THEN 'Nx' WHEN c_acctbal < 0 THEN 'n0 ' WHEN c_acctbal < 2500 THEN 'N1'
         WHEN c_acctbal < 8000 THEN 'N2b' ELSE 'N3' END AS N_raw,
    CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN 'T0' WHEN c_custkey % 3 = 0 THEN '4a'
         ELSE concat('T', cast(1 + c_custkey % 4 AS VARCHAR)) END AS T_raw,
    CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE cast(c_custkey % 5 AS INT) END AS fold
  FROM customer""")

view("fx_meta", """
  SELECT o_custkey AS c_custkey,
    cast(datediff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) AS RFS,
    max(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) AS event,
    sum(o_totalprice)/1e5 AS gtvp_ml, cast(count(*) % 4 AS INT) AS n_gtvn,
    CASE WHEN count(*) % 4 = 0 THEN 0.0::DOUBLE ELSE cast(o_custkey * 7 % 71 AS DOUBLE) END AS max_node_mm,
    CASE WHEN count(*) % 4 = 0 THEN 0.0::DOUBLE ELSE min(o_totalprice)/5000.0 END AS gtvn_total_ml,
    CASE WHEN count(*) % 4 = 0 THEN 'none' WHEN o_custkey % 7 = 0 THEN 'midline'
         WHEN o_custkey % 3 = 0 THEN 'bilateral' ELSE 'unilateral' END AS laterality,
    cast(count(*) AS DOUBLE) AS n_orders
  FROM orders GROUP BY o_custkey""")

view("fx_cohort", """
  SELECT c.*, m.* EXCLUDE (c_custkey), split_part(c.PatientID, '-', 1) AS center
  FROM fx_clinical c JOIN fx_meta m USING (c_custkey)""", ("fx_clinical", "fx_meta"))

view("fx_cells", """
  SELECT vec_id, label, generate_subscripts(embedding,1)-1 AS pos, cast(unnest(embedding) AS DOUBLE) v
  FROM embeddings""")


def _grid(threshold, offset):
    return f"""
  SELECT vec_id // 8 AS case_id,
    cast({offset} + pos // 16 + 4*((vec_id % 8) // 4) AS INT) AS z,
    cast({offset} + (pos // 4) % 4 + 4*((vec_id // 2) % 2) AS INT) AS y,
    cast({offset} + pos % 4 + 4*(vec_id % 2) AS INT) AS x,
    CASE WHEN v > {threshold} THEN CASE WHEN label % 3 = 0 THEN 1 ELSE 2 END ELSE 0 END AS label,
    CASE WHEN v > 0 THEN 12*v ELSE 0.0::DOUBLE END AS pet, 600*v - 420 AS ct
  FROM fx_cells"""


view("fx_voxels", _grid(0.18, 2), ("fx_cells",))
view("fx_truth", _grid(0.14, 2), ("fx_cells",))
view("fx_border", _grid(0.18, 0), ("fx_cells",))


def _header(size):
    return f"""
  SELECT case_id, {size} AS nx, {size} AS ny, {size} AS nz,
    cast(CASE case_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS DOUBLE) AS sx,
    cast(CASE case_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS DOUBLE) AS sy,
    CASE case_id % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 5.0::DOUBLE ELSE 8.0::DOUBLE END AS sz,
    0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, 0.0::DOUBLE AS oz,
    CASE WHEN case_id % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS dz
  FROM (SELECT DISTINCT vec_id // 8 AS case_id FROM embeddings)"""


view("fx_volumes", _header(12))
view("fx_border_volumes", _header(8))

view("steps26", """
  SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM (VALUES (-1),(0),(1)) a(d), (VALUES (-1),(0),(1)) b(d),
    (VALUES (-1),(0),(1)) c(d) WHERE NOT (a.d = 0 AND b.d = 0 AND c.d = 0)""")


def code(a=""):
    a = f"{a}." if a else ""
    return f"(cast({a}z AS BIGINT) * 1099511627776 + cast({a}y AS BIGINT) * 1048576 + {a}x)"


def closing_views(prefix, source, header, radii, border="erode"):
    """Views closing ``source`` (case_id, z, y, x) by each radius: <prefix>_closed."""
    inside = ("q.z BETWEEN 0 AND nz-1 AND q.y BETWEEN 0 AND ny-1 AND q.x BETWEEN 0 AND nx-1"
              if border == "erode" else "true")
    radius = lambda a: f"CASE WHEN merge_mm > 0 THEN greatest(1, cast(round_even(merge_mm / s{a}, 0) AS INT)) ELSE 0 END"
    values = ", ".join(f"({float(r)}::DOUBLE)" for r in radii)
    view(f"{prefix}_src", f"""
      SELECT s.case_id, merge_mm, z, y, x, nz, ny, nx, {radius('z')} AS rz, {radius('y')} AS ry, {radius('x')} AS rx
      FROM {source} s JOIN {header} h USING (case_id), (VALUES {values}) r(merge_mm)""", (source, header))
    view(f"{prefix}_dil", f"""
      SELECT DISTINCT case_id, merge_mm, z, y, x, nz, ny, nx, rz, ry, rx FROM (
        SELECT case_id, merge_mm, cast(z + a.i AS INT) AS z, cast(y + b.i AS INT) AS y, cast(x + c.i AS INT) AS x, nz, ny, nx, rz, ry, rx
        FROM {prefix}_src, range(-12, 13) a(i), range(-12, 13) b(i), range(-12, 13) c(i)
        WHERE abs(a.i) <= rz AND abs(b.i) <= ry AND abs(c.i) <= rx) q WHERE {inside}""", (f"{prefix}_src",))
    view(f"{prefix}_closed", f"""
      SELECT case_id, merge_mm, z, y, x FROM (
        SELECT d.case_id, d.merge_mm, cast(d.z + a.i AS INT) AS z, cast(d.y + b.i AS INT) AS y, cast(d.x + c.i AS INT) AS x, (2*rz+1)*(2*ry+1)*(2*rx+1) AS need
        FROM {prefix}_dil d, range(-12, 13) a(i), range(-12, 13) b(i), range(-12, 13) c(i)
        WHERE abs(a.i) <= rz AND abs(b.i) <= ry AND abs(c.i) <= rx)
      GROUP BY ALL HAVING count(*) = need""".replace("GROUP BY ALL", "GROUP BY case_id, merge_mm, z, y, x, need"),
         (f"{prefix}_dil",))


def component_views(prefix, source, keys):
    """Views labelling ``source`` (keys, z, y, x): <prefix>_comp with comp_id."""
    k = ", ".join(keys)
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM w.{c}" for c in keys)
    view(f"{prefix}_walk", f"""
      SELECT {k}, z, y, x, {code()} AS comp_id FROM {source}
      UNION
      SELECT {', '.join('n.' + c for c in keys)}, n.z, n.y, n.x, w.comp_id
      FROM {prefix}_walk w, steps26 d, {source} n
      WHERE {on} AND n.z = w.z + dz AND n.y = w.y + dy AND n.x = w.x + dx AND w.comp_id < {code('n')}""",
         (source, "steps26"))
    view(f"{prefix}_comp", f"SELECT {k}, z, y, x, min(comp_id) AS comp_id FROM {prefix}_walk GROUP BY {k}, z, y, x",
         (f"{prefix}_walk",))


def node_views(prefix, voxels, header, missing_pet=0.0):
    view(f"{prefix}_nodes", f"""
      SELECT c.case_id, merge_mm, comp_id, count(*) AS nvox, count(*) * (any_value(sz)*any_value(sy)*any_value(sx)/1000.0) AS vol_ml,
        greatest((max(c.z)-min(c.z)+1)*any_value(sz), (max(c.y)-min(c.y)+1)*any_value(sy), (max(c.x)-min(c.x)+1)*any_value(sx)) AS max_mm,
        coalesce(max(v.pet), {missing_pet}) AS suvmax,
        avg(c.x)*any_value(sx) AS cx_mm, avg(c.y)*any_value(sy) AS cy_mm, avg(c.z)*any_value(sz) AS cz_mm
      FROM {prefix}_comp c JOIN {header} h ON h.case_id = c.case_id
      LEFT JOIN {voxels} v ON v.case_id = c.case_id AND v.z = c.z AND v.y = c.y AND v.x = c.x
      GROUP BY c.case_id, merge_mm, comp_id""", (f"{prefix}_comp", header, voxels))


# the shipped cleanup: close 2 mm, gate, erase originals, keep the largest primary
view("gtvn", "SELECT case_id, z, y, x FROM fx_voxels WHERE label = 2", ("fx_voxels",))
closing_views("m2", "gtvn", "fx_volumes", [2.0])
component_views("m2", "m2_closed", ["case_id", "merge_mm"])
node_views("m2", "fx_voxels", "fx_volumes")
view("gtvp", "SELECT case_id, z, y, x FROM fx_voxels WHERE label = 1", ("fx_voxels",))
component_views("p1", "gtvp", ["case_id"])
view("p1_keep", """
  SELECT case_id, comp_id FROM (SELECT case_id, comp_id, count(*) AS n FROM p1_comp GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, comp_id) = 1""", ("p1_comp",))
view("m2_drop", """
  SELECT c.case_id, c.z, c.y, c.x FROM m2_comp c JOIN m2_nodes n USING (case_id, merge_mm, comp_id)
  JOIN gtvn g ON g.case_id = c.case_id AND g.z = c.z AND g.y = c.y AND g.x = c.x
  WHERE NOT (vol_ml >= 1.5 AND suvmax >= 3.0 AND max_mm >= 8.0)""", ("m2_comp", "m2_nodes", "gtvn"))
view("cleaned", """
  SELECT case_id, z, y, x, label, pet FROM fx_voxels v WHERE label = 2
    AND NOT EXISTS (SELECT 1 FROM m2_drop d WHERE d.case_id = v.case_id AND d.z = v.z AND d.y = v.y AND d.x = v.x)
  UNION ALL
  SELECT v.case_id, v.z, v.y, v.x, v.label, v.pet FROM fx_voxels v
  JOIN p1_comp c ON c.case_id = v.case_id AND c.z = v.z AND c.y = v.y AND c.x = v.x
  JOIN p1_keep k ON k.case_id = c.case_id AND k.comp_id = c.comp_id""", ("fx_voxels", "m2_drop", "p1_comp", "p1_keep"))
view("clean_n", "SELECT case_id, z, y, x FROM cleaned WHERE label = 2", ("cleaned",))
closing_views("g2", "clean_n", "fx_volumes", [2.0])
component_views("g2", "g2_closed", ["case_id", "merge_mm"])
node_views("g2", "fx_voxels", "fx_volumes")
view("midline", """
  SELECT h.case_id, coalesce(m.mx * sx, nx / 2.0 * sx) AS midline_mm FROM fx_volumes h
  LEFT JOIN (SELECT case_id, avg(x) AS mx FROM fx_voxels WHERE ct > -500 GROUP BY 1) m USING (case_id)""",
     ("fx_volumes", "fx_voxels"))


def geometry_view(name, nodes, mid):
    view(name, f"""
      SELECT h.case_id, round_even(coalesce(np, 0) * (sz*sy*sx/1000.0), 3) AS gtvp_ml,
        cast(coalesce(n, 0) AS INT) AS n_gtvn, round_even(coalesce(mm, 0.0), 1) AS max_node_mm,
        round_even(coalesce(nv, 0) * (sz*sy*sx/1000.0), 3) AS gtvn_total_ml,
        CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN l AND r THEN 'bilateral' WHEN l OR r THEN 'unilateral' ELSE 'midline' END AS laterality
      FROM fx_volumes h
      LEFT JOIN (SELECT case_id, count(*) AS n, max(max_mm) AS mm, cast(sum(nvox) AS BIGINT) AS nv,
                   bool_or(cx_mm < midline_mm - 6) AS l, bool_or(cx_mm > midline_mm + 6) AS r
                 FROM {nodes} JOIN {mid} USING (case_id) GROUP BY 1) g USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS np FROM cleaned WHERE label = 1 GROUP BY 1) p USING (case_id)""",
         ("fx_volumes", nodes, mid, "cleaned"))


view("midline_image", "SELECT case_id, nx / 2.0 * sx AS midline_mm FROM fx_volumes", ("fx_volumes",))
geometry_view("geometry", "g2_nodes", "midline")
geometry_view("geometry_image", "g2_nodes", "midline_image")


def rule(n="n_gtvn", mm="max_node_mm", lat="laterality", n3="55.0", n1="35.0"):
    return (f"CASE WHEN {n} = 0 THEN 'N0' WHEN {mm} > {n3} THEN 'N3' WHEN {n} = 1 AND "
            f"{lat} IN ('unilateral','midline') AND {mm} <= {n1} THEN 'N1' ELSE 'N2' END")
