"""Shared pieces of the ANSI SQL that states each query a second time."""

from __future__ import annotations

import re

from .. import constants as K

R2 = 2 * K.EARTH_RADIUS_M


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians({lon2}-{lon1})/2),2)")
    return f"round(asin(sqrt(least(1.0,{a})))*{R2!r},6)"


CTES: dict[str, str] = {}


def cte(name: str, body: str) -> str:
    CTES[name] = body
    return name


def compose(body: str) -> str:
    """Prefix a statement with the shared sub-queries it mentions, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])
    visit(body)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    if not parts:
        return body
    own = body.lstrip()
    if own.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + own[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


cte("homes", """
SELECT p_partkey AS property_id, p_name, CAST(p_size AS DOUBLE) AS floor_area,
  CASE p_type WHEN 'STANDARD' THEN 'detached' WHEN 'PROMO' THEN 'semi_detached'
    WHEN 'ECONOMY' THEN 'terraced' WHEN 'MEDIUM' THEN 'flat' WHEN 'LARGE' THEN 'house'
    WHEN 'SMALL' THEN 'other' END AS property_type,
  'S'||(p_partkey%1000) AS sector, 'O'||(p_partkey%500) AS outcode, 'D'||(p_partkey%100) AS district,
  'C'||(p_partkey%25) AS county,
  50.0::DOUBLE + ((p_partkey%100)//10)*0.2::DOUBLE + ((p_partkey*7919)%1000)/10000.0::DOUBLE AS lat,
  -2.0::DOUBLE + (p_partkey%10)*0.2::DOUBLE + ((p_partkey*104729)%1000)/10000.0::DOUBLE AS lon,
  list_extract(['MK','SW','EH','CF','BT','G','LL','N'], (p_partkey%1000)%8+1) AS pc_area,
  list_extract(['MK','SW','EH','CF','BT','G','LL','N'], (p_partkey%1000)%8+1)
    ||(((p_partkey%1000)//8)%9+1) AS pc_outcode,
  list_extract(['MK','SW','EH','CF','BT','G','LL','N'], (p_partkey%1000)%8+1)
    ||(((p_partkey%1000)//8)%9+1)||(((p_partkey%1000)//72)%10)
    ||substr('ABDEFGHJLNPQRSTUWXYZ',CAST((p_partkey%1000)%20+1 AS INTEGER),1)
    ||substr('ABDEFGHJLNPQRSTUWXYZ',CAST(((p_partkey%1000)//20)%20+1 AS INTEGER),1) AS postcode,
  r_name AS country, p_type<>'SMALL' AS is_residential
FROM part JOIN nation ON p_partkey%25=n_nationkey JOIN region ON n_regionkey=r_regionkey""")

cte("sales", """
SELECT l_orderkey||':'||l_linenumber AS source_record_id,
  l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey||':'||CAST(l_quantity AS BIGINT) AS sale_key,
  h.property_id, l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS transaction_date,
  l_extendedprice AS price, l_quantity AS sale_area,
  CASE WHEN l_returnflag='R' THEN 'ADDITIONAL' ELSE 'STANDARD' END AS market_value_basis,
  CASE WHEN l_quantity>0 THEN l_extendedprice/l_quantity END AS price_per_sqm,
  h.floor_area, h.property_type, h.sector, h.outcode, h.district, h.county, h.lat, h.lon,
  h.pc_area, h.pc_outcode, h.postcode, h.country, h.is_residential,
  CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem JOIN homes h ON l_partkey=h.property_id""")

cte("evid", "SELECT * FROM sales WHERE market_value_basis='STANDARD' AND is_residential")
