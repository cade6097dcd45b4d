"""Eight small tables with planted defects, and the 42 checks that find them.

Clean rows follow a rule; every defect is one override. Only the keys, the defects and the check
parameters matter for the outcomes.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from plumbline.config.specs import spec

AS_OF = dt.datetime(2026, 12, 1)
T0 = dt.datetime(2024, 9, 1, 9)


def _rows(columns, count, base, overrides):
    out = []
    for i in range(1, count + 1):
        row = {**base(i), **overrides.get(i, {})}
        out.append(tuple(row[c] for c in columns))
    return out


CUSTOMERS = (
    "customer_id bigint, first_name string, last_name string, email string, phone string, country string, "
    "state string, postal_code string, customer_status string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
PRODUCTS = (
    "product_id bigint, product_name string, category string, price decimal(10,2), weight_kg decimal(8,2), "
    "is_active boolean, created_at timestamp_ntz"
)
ORDERS = (
    "order_id bigint, customer_id bigint, order_date date, order_status string, order_amount decimal(12,2), "
    "currency string, country string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
ORDER_ITEMS = (
    "item_id bigint, order_id bigint, product_id bigint, quantity bigint, unit_price decimal(10,2), "
    "line_total decimal(12,2), discount_pct decimal(5,2), discount_amt decimal(10,2), created_at timestamp_ntz"
)
EMPLOYEES = (
    "employee_id bigint, employee_name string, department string, manager_id bigint, hire_date date, "
    "salary decimal(10,2), employee_level bigint, created_at timestamp_ntz, updated_at timestamp_ntz"
)
AUDIT_LOG = (
    "log_id bigint, table_name string, record_id bigint, cdc_operation string, cdc_sequence bigint, "
    "old_value string, new_value string, changed_by string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
DAILY_AGGREGATES = (
    "agg_id bigint, agg_date date, table_name string, total_rows bigint, total_amount decimal(14,2), "
    "avg_amount decimal(10,2), created_at timestamp_ntz"
)
FILE_LOG = (
    "ingestion_id bigint, file_name string, file_hash string, file_size_bytes bigint, row_count bigint, "
    "ingested_at timestamp_ntz, status string"
)


def names(ddl):
    return [part.split()[0] for part in ddl.split(", ")]


def customers():
    def base(i):
        return dict(
            customer_id=i, first_name=f"Given{i}", last_name=f"Family{i}", email=f"person{i}@mail.example",
            phone=f"555-{i:04d}", country="US", state="CA", postal_code=f"{90000 + i}",
            customer_status="ACTIVE", created_at=T0, updated_at=T0 + dt.timedelta(days=30),
        )

    return _rows(names(CUSTOMERS), 15, base, {
        4: dict(country="UK", state="LND", postal_code="EC1A1BB"),
        6: dict(first_name=None, email=None),
        7: dict(first_name="Given2", last_name="Family2", email="person2@mail.example", phone="555-0002"),
        8: dict(email="no mailbox here"),
        9: dict(customer_status="DELETED"),
        10: dict(first_name="G"),
        11: dict(country="UK", postal_code="90001"),
        12: dict(created_at=dt.datetime(2022, 1, 1, 10), updated_at=dt.datetime(2022, 1, 1, 10)),
        13: dict(updated_at=T0 - dt.timedelta(days=60)),
        14: dict(postal_code="ABCXYZ"),
        15: dict(customer_id=1),
    })


def products():
    def base(i):
        return dict(product_id=100 + i, product_name=f"Article {i}", category="Furniture", price=D("20.00") + i,
                    weight_kg=D("1.50"), is_active=True, created_at=T0)

    return _rows(names(PRODUCTS), 12, base, {
        4: dict(weight_kg=D("35.00")),
        7: dict(price=D("-50.00")),
        8: dict(category="INVALID_CAT"),
        9: dict(weight_kg=D("9999.00")),
        10: dict(price=D("0.00"), is_active=False),
        11: dict(product_name=None),
        12: dict(weight_kg=D("-2.00")),
    })


def orders():
    day = {1: dt.date(2024, 6, 1), 2: dt.date(2024, 6, 15)}

    def base(i):
        return dict(order_id=1000 + i, customer_id=1 + i % 5, order_date=day.get(i, dt.date(2024, 7, i)),
                    order_status="COMPLETED", order_amount=D("100.00") + i, currency="USD", country="US",
                    created_at=T0, updated_at=T0)

    rows = _rows(names(ORDERS), 12, base, {
        2: dict(order_amount=D("279.98")),
        4: dict(currency="GBP", country="UK"),
        6: dict(order_amount=D("-150.00")),
        7: dict(order_date=dt.date(2029, 12, 31)),
        8: dict(customer_id=999),
        9: dict(currency="GBP"),
        10: dict(order_status="VOIDED"),
        11: dict(order_amount=None),
        12: {c: None for c in names(ORDERS) if c != "order_id"},
    })
    return rows + [rows[0]]


def order_items():
    def base(i):
        return dict(item_id=i, order_id=1000 + i, product_id=100 + (i - 1) % 8 + 1, quantity=1,
                    unit_price=D("25.00"), line_total=D("25.00"), discount_pct=D("0.00"), discount_amt=D("0.00"),
                    created_at=T0)

    return _rows(names(ORDER_ITEMS), 15, base, {
        9: dict(product_id=999),
        10: dict(unit_price=D("100.00"), line_total=D("999.00")),
        11: dict(quantity=10000, unit_price=D("12.99"), line_total=D("129900.00")),
        12: dict(discount_pct=D("10.00")),
        13: dict(quantity=-5, line_total=D("-125.00")),
        14: dict(unit_price=D("99999.00"), line_total=D("99999.00")),
        15: {c: None for c in names(ORDER_ITEMS) if c not in ("item_id", "order_id")},
    })


def employees():
    department = {1: "Board", 3: "Sales", 5: "Sales", 7: "Marketing", 8: "Finance", 9: "Finance", 11: "Sales", 12: "HR"}
    manager = {1: None, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4, 7: 999, 8: 9, 9: 8, 10: 2, 11: 3, 12: 1, 13: 4}

    def base(i):
        return dict(employee_id=i, employee_name=f"Person {i}", department=department.get(i, "Engineering"),
                    manager_id=manager[i], hire_date=dt.date(2020, 1, i), salary=D("90000.00"),
                    employee_level=3, created_at=T0, updated_at=T0)

    return _rows(names(EMPLOYEES), 13, base, {10: dict(salary=D("-5000.00")), 12: dict(employee_name=None)})


def audit_log():
    def base(i):
        return dict(log_id=i, table_name="CUSTOMERS", record_id=i, cdc_operation="I", cdc_sequence=i,
                    old_value=None, new_value='{"n":1}', changed_by="LOADER", created_at=T0, updated_at=T0)

    rows = _rows(names(AUDIT_LOG), 14, base, {
        4: dict(table_name="ORDERS", record_id=1001),
        9: dict(cdc_operation="X"),
        10: dict(table_name="ORDERS", record_id=1004, cdc_operation="D", cdc_sequence=15),
        11: dict(table_name="ORDERS", record_id=1004, cdc_sequence=15, created_at=T0 + dt.timedelta(hours=1),
                 updated_at=T0 + dt.timedelta(hours=1)),
        12: dict(changed_by=None),
        13: dict(updated_at=T0 - dt.timedelta(days=1)),
        14: dict(table_name=None, record_id=None),
    })
    return rows + [(15, *rows[3][1:])]


def daily_aggregates():
    def base(i):
        return dict(agg_id=i, agg_date=dt.date(2024, 8, i), table_name="ORDERS", total_rows=2,
                    total_amount=D("200.00"), avg_amount=D("100.00"), created_at=T0)

    return _rows(names(DAILY_AGGREGATES), 11, base, {
        6: dict(agg_date=dt.date(2024, 6, 15), table_name="ORDERS_RECON_TARGET", total_rows=3,
                total_amount=D("999.99"), avg_amount=D("333.33")),
        7: dict(total_rows=0, total_amount=D("0.00"), avg_amount=D("0.00")),
        8: dict(total_amount=D("100.00"), avg_amount=D("500.00")),
        9: dict(agg_date=None),
        10: dict(agg_date=dt.date(2024, 8, 1), total_amount=D("199.00"), avg_amount=D("99.50")),
        11: dict(agg_date=dt.date(2022, 1, 1)),
    })


def file_ingestion_log():
    def base(i):
        return dict(ingestion_id=i, file_name=f"load_{i}.csv", file_hash=f"hash{i}", file_size_bytes=1000 * i,
                    row_count=10 * i, ingested_at=T0, status="SUCCESS")

    return _rows(names(FILE_LOG), 11, base, {
        6: dict(file_name="load_1.csv", file_hash="hash1"),
        7: dict(file_name="load_1.csv", file_hash="hash1"),
        8: dict(file_name=None),
        9: dict(status="UNKNOWN"),
        10: dict(file_size_bytes=-500),
        11: dict(file_name="x" * 209 + ".csv", status="FAILED"),
    })


TABLES = {
    "customers": (CUSTOMERS, customers),
    "products": (PRODUCTS, products),
    "orders": (ORDERS, orders),
    "order_items": (ORDER_ITEMS, order_items),
    "employees": (EMPLOYEES, employees),
    "audit_log": (AUDIT_LOG, audit_log),
    "daily_aggregates": (DAILY_AGGREGATES, daily_aggregates),
    "file_ingestion_log": (FILE_LOG, file_ingestion_log),
}


def frames(spark):
    return {name: spark.createDataFrame(rows(), ddl) for name, (ddl, rows) in TABLES.items()}


# Check parameters of the 42 assignments.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def specs():
    return [
        spec(1, "customers", "first_name", record_id="customer_id"),
        spec(1, "products", "product_name", record_id="product_id"),
        spec(1, "orders", "order_amount", record_id="order_id"),
        spec(2, "customers", "customer_id", record_id="customer_id"),
        spec(2, "orders", "order_id", record_id="order_id"),
        spec(3, "customers", columns="first_name,last_name,email,phone", where_clause=""),
        spec(3, "audit_log", columns="table_name,record_id,cdc_sequence", where_clause="WHERE table_name IS NOT NULL"),
        spec(4, "orders", "customer_id", fk_column="customer_id", parent_table="customers", pk_column="customer_id"),
        spec(4, "order_items", "product_id", fk_column="product_id", parent_table="products", pk_column="product_id"),
        spec(5, "customers", "postal_code", record_id="customer_id", expected_type="NUMBER", filter="country = 'US'"),
        spec(6, "products", "price", record_id="product_id", min_value=0, max_value=99999),
        spec(6, "order_items", "unit_price", record_id="item_id", min_value=0, max_value=10000),
        spec(7, "customers", "first_name", record_id="customer_id", min_length=2, max_length=50),
        spec(7, "file_ingestion_log", "file_name", record_id="ingestion_id", min_length=1, max_length=200),
        spec(8, "customers", "email", record_id="customer_id", pattern=EMAIL),
        spec(9, "customers", "customer_status", record_id="customer_id", allowed_values="'ACTIVE','INACTIVE','SUSPENDED'"),
        spec(9, "products", "category", record_id="product_id",
             allowed_values="'Electronics','Furniture','Accessories','Stationery'"),
        spec(9, "orders", "order_status", record_id="order_id",
             allowed_values="'PENDING','SHIPPED','COMPLETED','CANCELLED'"),
        spec(10, "orders", "order_date", record_id="order_id", rule_expression="order_date > CURRENT_DATE()"),
        spec(10, "daily_aggregates", "avg_amount", record_id="agg_id",
             rule_expression="avg_amount > total_amount AND total_amount IS NOT NULL"),
        spec(11, "customers", "country,state", record_id="customer_id",
             rule_expression="country = 'UK' AND postal_code RLIKE '^[0-9]+$'"),
        spec(11, "orders", "currency,country", record_id="order_id",
             rule_expression="currency = 'GBP' AND country = 'US'"),
        spec(11, "order_items", "discount_pct,discount_amt", record_id="item_id",
             rule_expression="discount_pct > 0 AND discount_amt = 0"),
        spec(12, "customers", "updated_at", record_id="customer_id", timestamp_column="updated_at",
             max_staleness_days=1500),
        spec(13, "orders", record_id="order_id",
             null_check_expression="customer_id IS NULL AND order_date IS NULL AND order_status IS NULL AND order_amount IS NULL"),
        spec(14, "daily_aggregates", "total_rows", record_id="agg_id", volume_column="total_rows", date_column="agg_date"),
        spec(15, "employees", "department", max_pct=30),
        spec(16, "order_items", "quantity", record_id="item_id", z_threshold=3),
        spec(16, "products", "weight_kg", record_id="product_id", z_threshold=3),
        spec(17, "products"),
        spec(18, "daily_aggregates", source_table="orders", src_date_col="order_date", src_amount_col="order_amount",
             tgt_date_col="agg_date", tgt_count_col="total_rows", tgt_amount_col="total_amount",
             tgt_filter_col="table_name", tgt_filter_val="ORDERS_RECON_TARGET"),
        spec(19, "file_ingestion_log", "file_name", file_column="file_name"),
        spec(20, "orders", "order_amount", record_id="order_id"),
        spec(20, "employees", "salary", record_id="employee_id"),
        spec(21, "order_items", "line_total", record_id="item_id", qty_column="quantity", price_column="unit_price",
             total_column="line_total", tolerance="0.01"),
        spec(22, "employees", id_column="employee_id", parent_column="manager_id"),
        spec(23, "daily_aggregates", date_column="agg_date", group_column="table_name", group_value="ORDERS",
             amount_column="total_amount"),
        spec(24, "customers", "updated_at", record_id="customer_id", rule_expression="updated_at < created_at"),
        spec(24, "audit_log", "changed_by", record_id="log_id", rule_expression="changed_by IS NULL"),
        spec(24, "audit_log", "updated_at", record_id="log_id", rule_expression="updated_at < created_at"),
        spec(25, "audit_log", "cdc_operation", record_id="log_id", cdc_op_column="cdc_operation",
             rule_expression="cdc_operation NOT IN ('I','U','D')"),
        spec(25, "audit_log", "cdc_sequence", record_id="log_id", cdc_op_column="cdc_sequence",
             duplicate_keys="table_name,record_id,cdc_sequence", group_filter="table_name IS NOT NULL",
             row_filter="table_name = 'ORDERS' AND record_id = 1004"),
    ]


# Failure count and status per (check, column), and the health score of each table.
OUTCOMES = {
    "audit_log": ({(3, None): (2, "FAIL"), (24, "changed_by"): (1, "WARNING"), (24, "updated_at"): (1, "WARNING"),
                   (25, "cdc_operation"): (1, "FAIL"), (25, "cdc_sequence"): (2, "FAIL")}, "15.38"),
    "customers": ({(1, "first_name"): (1, "FAIL"), (2, "customer_id"): (1, "FAIL"), (3, None): (1, "FAIL"),
                   (5, "postal_code"): (1, "WARNING"), (7, "first_name"): (1, "FAIL"), (8, "email"): (1, "WARNING"),
                   (9, "customer_status"): (1, "WARNING"), (11, "country,state"): (1, "WARNING"),
                   (12, "updated_at"): (1, "FAIL"), (24, "updated_at"): (1, "WARNING")}, "20.75"),
    "daily_aggregates": ({(10, "avg_amount"): (1, "FAIL"), (14, "total_rows"): (1, "FAIL"), (18, None): (1, "FAIL"),
                          (23, None): (1, "FAIL")}, "0.00"),
    "employees": ({(15, "department"): (1, "FAIL"), (20, "salary"): (1, "FAIL"), (22, None): (3, "FAIL")}, "0.00"),
    "file_ingestion_log": ({(7, "file_name"): (1, "FAIL"), (19, "file_name"): (1, "FAIL")}, "0.00"),
    "orders": ({(1, "order_amount"): (2, "FAIL"), (2, "order_id"): (1, "FAIL"), (4, "customer_id"): (1, "FAIL"),
                (9, "order_status"): (1, "WARNING"), (10, "order_date"): (1, "FAIL"),
                (11, "currency,country"): (1, "WARNING"), (13, None): (1, "FAIL"), (20, "order_amount"): (1, "FAIL")},
               "9.57"),
    "order_items": ({(4, "product_id"): (1, "FAIL"), (6, "unit_price"): (1, "WARNING"),
                     (11, "discount_pct,discount_amt"): (1, "WARNING"), (16, "quantity"): (1, "WARNING"),
                     (21, "line_total"): (1, "FAIL")}, "24.07"),
    "products": ({(1, "product_name"): (1, "FAIL"), (6, "price"): (1, "WARNING"), (9, "category"): (1, "WARNING"),
                  (16, "weight_kg"): (1, "WARNING"), (17, None): (1, "FAIL")}, "23.08"),
}
