"""DuckDB text of the three transaction views, used as CTEs by the oracle SQL.

They mirror ``ledgerlens.sources.fixtures`` and the cleaning operators.
"""

from __future__ import annotations

NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

CITY = ("case r_name when 'AFRICA' then 'Hà Nội' when 'AMERICA' then 'TP.HCM' "
        "when 'ASIA' then 'Đà Nẵng' when 'EUROPE' then 'Cần Thơ' else 'Hải Phòng' end")

TX_RAW = f"""tx_raw as (
  select concat('E', cast(event_id as varchar)) as Transaction_ID,
         concat('U', cast(user_id as varchar)) as User_ID,
         case when event_id % 89 = 0 then 'abc' when event_id % 91 = 0 then 'NA'
              else cast(cast(value as decimal(18,2)) as varchar) end as Amount_VND,
         case when event_id % 97 = 0 then 'not-a-date'
              else strftime(ts, '%Y-%m-%d %H:%M:%S') end as Timestamp,
         case cast(json_extract(props, '$.k') as integer) % 4 when 0 then 'E-Wallet'
              when 1 then 'Credit Card' when 2 then 'Bank Transfer' else 'QR' end as Payment_Method,
         case event_type when 'click' then 'Transport' when 'view' then 'Utilities'
              when 'purchase' then 'Shopping' when 'signup' then 'Supermarket'
              else 'Food & Beverage' end as Merchant_Category,
         case when event_id % 83 = 0 then null else {CITY} end as Location,
         case when event_id % 101 = 0 then 'x'
              when value >= 100 and hour(ts) < 6 then '1' else '0' end as Is_Fraud,
         case when event_id % 103 = 0 then 'h' else cast(hour(ts) as varchar) end as Hour,
         case when isodow(ts) >= 6 then '1' else '0' end as Is_Weekend
  from events join customer on user_id = c_custkey
              join nation on c_nationkey = n_nationkey
              join region on n_regionkey = r_regionkey)"""


def _num(c: str) -> str:
    return f"(case when regexp_full_match({c}, '{NUM}') then try_cast(trim({c}) as double) end)"


def _int(c: str, default: int) -> str:
    n = _num(c)
    return f"coalesce(case when abs({n}) < 2147483648 then cast(trunc({n}) as integer) end, {default})"


CAT_MAP = ("case Merchant_Category when 'Transport' then 'Giao thông & Di chuyển' "
           "when 'Utilities' then 'Điện nước & Tiện ích' when 'Supermarket' then 'Siêu thị' "
           "when 'Shopping' then 'Mua sắm' when 'Food & Beverage' then 'Ăn uống' "
           "else Merchant_Category end")
PAY_MAP = "case when Payment_Method = 'E-Wallet' then 'Ví điện tử' else Payment_Method end"

TX = f"""tx as (
  select Transaction_ID, User_ID,
         coalesce({_num('Amount_VND')}, 0.0) as Amount_VND,
         try_strptime(Timestamp, '%Y-%m-%d %H:%M:%S') as Timestamp,
         {PAY_MAP} as Payment_Method,
         {CAT_MAP} as Merchant_Category,
         Location,
         {_int('Is_Fraud', 0)} as Is_Fraud,
         {_int('Hour', 12)} as Hour,
         {_int('Is_Weekend', 0)} as Is_Weekend
  from tx_raw where try_strptime(Timestamp, '%Y-%m-%d %H:%M:%S') is not null)"""

TX_FRAUD = f"""tx_fraud as (
  select Transaction_ID, User_ID,
         coalesce({_num('Amount_VND')}, 0.0) as Amount_VND,
         Timestamp,
         {PAY_MAP} as Payment_Method,
         {CAT_MAP} as Merchant_Category,
         Location,
         {_int('Is_Fraud', 0)} as Is_Fraud,
         {_int('Hour', 12)} as Hour,
         {_int('Is_Weekend', 0)} as Is_Weekend
  from tx_raw)"""

TX_O = f"""tx_o as (
  select cast(o_orderkey as varchar) as Transaction_ID, cast(o_custkey as varchar) as User_ID,
         o_totalprice as Amount_VND, cast(o_orderdate as timestamp) as Timestamp,
         o_orderpriority as Payment_Method, c_mktsegment as Merchant_Category,
         {CITY} as Location,
         cast(case when o_orderstatus = 'F' then 1 else 0 end as integer) as Is_Fraud
  from orders join customer on o_custkey = c_custkey
              join nation on c_nationkey = n_nationkey
              join region on n_regionkey = r_regionkey)"""

_DEPS = {"tx_raw": [], "tx": ["tx_raw"], "tx_fraud": ["tx_raw"], "tx_o": []}
_TEXT = {"tx_raw": TX_RAW, "tx": TX, "tx_fraud": TX_FRAUD, "tx_o": TX_O}


def with_views(body: str, *views: str, extra: list[str] | None = None) -> str:
    """``WITH <views and their dependencies>, <extra CTEs> <body>``."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = [_TEXT[v] for v in order] + list(extra or [])
    return "with " + ",\n".join(ctes) + "\n" + body


def money_sum(c: str = "Amount_VND") -> str:
    return f"sum(try_cast({c} as decimal(28,6)))"


def hash_bucket(c: str = "Transaction_ID") -> str:
    return f"(cast(('0x' || substr(md5(coalesce(cast({c} as varchar), '')), 1, 8)) as ubigint) % 100)"
