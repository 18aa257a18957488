"""DuckDB oracle SQL: shared CTEs for the bound tables, and a composer.

``sql(body, 'a', 'b')`` returns ``WITH <a, b and their dependencies> body``.
The CTE texts below are the fixture binding in DuckDB's dialect plus the
derived frames many oracle queries share (cleaned lines, windows, grids).
"""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


def _order(names, out, seen):
    for n in names:
        if n in seen:
            continue
        seen.add(n)
        _order(CTES[n][1], out, seen)
        out.append(n)


def stable_rounding(text: str) -> str:
    """Rewrite every ``round(x, 6)`` as ``round(round(x, 9), 6)`` - the same
    two-step rounding the Spark side applies to its outputs."""
    out, i, low = [], 0, text.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[j + 6:k - 1]
        head, _, scale = inner.rpartition(",")
        if scale.strip() == "6" and head:
            out.append(text[i:j] + f"round(round({stable_rounding(head)}, 9), 6)")
        else:
            out.append(text[i:j] + "round(" + stable_rounding(inner) + ")")
        i = k


def sql(body: str, *names: str) -> str:
    order: list[str] = []
    _order(names, order, set())
    b = body.strip()
    if not order:
        return stable_rounding(b)
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    if b[:4].lower() == "with":
        return stable_rounding("WITH " + ",\n".join(parts) + ",\n" + b[4:].lstrip())
    return stable_rounding("WITH " + ",\n".join(parts) + "\n" + b)


# ----------------------------------------------------------------- bindings

cte("order_lines", """
select l.l_orderkey as order_ID, o.o_custkey as user_ID, l.l_partkey as sku_ID,
  o.o_orderdate as order_time, cast(o.o_orderdate as date) as order_date,
  l.l_quantity as quantity, l.l_extendedprice/l.l_quantity as original_unit_price,
  l.l_extendedprice/l.l_quantity*(1-l.l_discount) as final_unit_price,
  l.l_extendedprice/l.l_quantity*l.l_discount as direct_discount_per_unit,
  cast(0 as double) as quantity_discount_per_unit, cast(0 as double) as bundle_discount_per_unit,
  cast(0 as double) as coupon_discount_per_unit,
  case l.l_returnflag when 'R' then '1' when 'A' then '0' else '' end as gift_item,
  case when l.l_linenumber = 7 then '-' else cast(1 + l.l_partkey % 3 as varchar) end as promise,
  case when p.p_type = 'PROMO' then 2 else 1 end as type,
  s.s_nationkey as dc_ori, c.c_nationkey as dc_des
from lineitem l join orders o on l.l_orderkey=o.o_orderkey join customer c on o.o_custkey=c.c_custkey
join supplier s on l.l_suppkey=s.s_suppkey join part p on l.l_partkey=p.p_partkey
""")

cte("network", "select n_nationkey as dc_ID, n_regionkey as region_ID from nation")

cte("clusters", "select p_partkey as sku_ID, p_size % 8 as sku_cluster_ID from part where p_partkey % 50 <> 0")

cte("clicks", """
select case when user_id % 50 = 0 then '-' else cast(user_id as varchar) end as user_ID,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as sku_ID, ts as request_time, event_type as channel
from events where event_type in ('click','view')
""")

cte("funnel_orders", """
select cast(user_id as varchar) as user_ID, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as sku_ID,
  ts as order_time from events where event_type = 'purchase'
""")

cte("inventory", """
select distinct s.s_nationkey as dc_ID, l.l_partkey as sku_ID, cast(l.l_shipdate as date) as date
from lineitem l join supplier s on l.l_suppkey=s.s_suppkey
""")

cte("sku", """
select p_partkey as sku_ID, case when p_type='PROMO' then 2 else 1 end as type, p_brand as brand_ID,
  case when p_partkey % 7 = 0 then '-' else cast(p_size as varchar) end as attribute1,
  case when p_partkey % 5 = 0 then '-' else p_type end as attribute2 from part
""")

cte("users", "select cast(c_custkey as varchar) as user_ID, "
             "case when c_custkey % 10 <> 0 then c_mktsegment end as region from customer")

cte("delivery", """
select l_orderkey as order_ID, l_linenumber as package_ID,
  o_orderdate + to_hours(cast(l_linenumber as int)) as ship_out_time,
  o_orderdate + to_hours(cast(l_linenumber + l_suppkey % 24 as int)) as arr_station_time,
  o_orderdate + to_hours(cast(l_linenumber + l_suppkey % 24 + l_partkey % 60 as int)) as arr_time
from lineitem join orders on l_orderkey=o_orderkey
""")

# ----------------------------------------------------------------- derived

cte("clean_lines", """
select order_ID, user_ID, sku_ID, order_time, order_date,
  coalesce(try_cast(quantity as double), 0.0) as quantity,
  coalesce(try_cast(original_unit_price as double), 0.0) as original_unit_price,
  coalesce(try_cast(final_unit_price as double), 0.0) as final_unit_price,
  coalesce(try_cast(direct_discount_per_unit as double), 0.0) as direct_discount_per_unit,
  coalesce(try_cast(quantity_discount_per_unit as double), 0.0) as quantity_discount_per_unit,
  coalesce(try_cast(bundle_discount_per_unit as double), 0.0) as bundle_discount_per_unit,
  coalesce(try_cast(coupon_discount_per_unit as double), 0.0) as coupon_discount_per_unit,
  case when gift_item is null or gift_item in ('nan','None','NaN') then '' else gift_item end as gift_item,
  promise, type, dc_ori, dc_des,
  direct_discount_per_unit + quantity_discount_per_unit + bundle_discount_per_unit + coupon_discount_per_unit
    as total_discount_per_unit,
  case when (direct_discount_per_unit + quantity_discount_per_unit + bundle_discount_per_unit
             + coupon_discount_per_unit) > 0 or trim(coalesce(gift_item, '')) <> '' then 1 else 0 end
    as promo_line_flag,
  case when trim(coalesce(gift_item, '')) <> '' then 1 else 0 end as gift_rate_flag
from order_lines where order_date is not null
""", "order_lines")

cte("win_lines", "select * from clean_lines where order_date between date '1998-03-01' and date '1998-03-31'",
    "clean_lines")
cte("train_lines", "select * from win_lines where order_date between date '1998-03-01' and date '1998-03-24'",
    "win_lines")
cte("test_lines", "select * from win_lines where order_date between date '1998-03-25' and date '1998-03-31'",
    "win_lines")


def grid_cte(name: str, lines: str, start: str, end: str, key: str = "dc_des",
             universe: str = "mapping", key_expr: str | None = None, extra_deps: tuple = ()) -> None:
    """Dense (date, key, cluster) demand grid over lines mapped to clusters."""
    kx = key_expr or f"t.{key}"
    mapped = f"(select t.order_date, {kx} as {key}, c.sku_cluster_ID, t.quantity from {lines} t " \
             f"join clusters c on t.sku_ID = c.sku_ID)"
    cl = ("(select distinct sku_cluster_ID from clusters where sku_cluster_ID is not null)"
          if universe == "mapping" else "(select distinct sku_cluster_ID from m)")
    body = f"""
with m as {mapped}
select g.order_date, g.{key}, g.sku_cluster_ID, coalesce(d.demand, 0.0) as demand
from (select cast(ds.d as date) as order_date, w.{key}, k.sku_cluster_ID
      from generate_series(timestamp '{start}', timestamp '{end}', interval 1 day) ds(d)
      cross join (select distinct {key} from m where {key} is not null) w
      cross join {cl} k) g
left join (select order_date, {key}, sku_cluster_ID, sum(quantity) as demand from m group by all) d
  on g.order_date = d.order_date and g.{key} = d.{key} and g.sku_cluster_ID = d.sku_cluster_ID
"""
    cte(name, body, lines, "clusters", *extra_deps)


grid_cte("wh_grid_train", "train_lines", "1998-03-01", "1998-03-24")
grid_cte("wh_grid_test", "test_lines", "1998-03-25", "1998-03-31")

cte("series_train", """
select sku_cluster_ID, dc_des, count(*) as total_days, count_if(demand = 0) as zero_days,
  avg(demand) as mean_demand, coalesce(stddev_samp(demand), 0.0) as std_demand,
  count_if(demand = 0) / count(*) as zero_rate,
  coalesce(coalesce(stddev_samp(demand), 0.0) / nullif(avg(demand), 0), 0.0) as cv
from wh_grid_train group by sku_cluster_ID, dc_des
""", "wh_grid_train")

cte("series_flags", """
select *, cast(zero_rate >= 0.7 as integer) as high_sparsity,
  cast(coalesce(std_demand = 0.0 or cv < 0.1, false) as integer) as low_variance
from series_train
""", "series_train")

cte("cluster_sum", """
select sku_cluster_ID, count(distinct dc_des) as warehouses, count(*) as series,
  cast(sum(high_sparsity) as bigint) as high_sparsity_series, cast(sum(low_variance) as bigint) as low_variance_series,
  avg(zero_rate) as avg_zero_rate, avg(cv) as avg_cv,
  sum(high_sparsity) / count(*) as high_sparsity_share, sum(low_variance) / count(*) as low_variance_share
from series_flags group by sku_cluster_ID
""", "series_flags")
