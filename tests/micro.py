"""Hand-made clean tables for rule tests."""

import datetime as dt

from shopmetrics.sources.fixtures import LazyFrames

USERS = "user_id bigint, region string, customer_type string, loyalty_flag boolean, signup_date date"
PRODUCTS = "product_id bigint, product_name string, category string, base_price double, margin_rate double"
SESSIONS = "session_id bigint, user_id bigint, session_start timestamp_ntz, device_type string, channel string"
EVENTS = ("event_id bigint, session_id bigint, user_id bigint, event_timestamp timestamp_ntz, event_name string, "
          "product_id bigint, device_type string, region string, customer_type string, loyalty_flag boolean, "
          "channel string")
ORDERS = ("order_id bigint, session_id bigint, user_id bigint, order_timestamp timestamp_ntz, revenue double, "
          "basket_value double, items_count bigint, device_type string, region string, customer_type string, "
          "loyalty_flag boolean, channel string, variant string")
ASSIGN = "user_id bigint, experiment_name string, variant string, assigned_at timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


def tables(spark, users=(), products=(), sessions=(), events=(), orders=(), assignments=()):
    spec = {"clean_users": (users, USERS), "clean_products": (products, PRODUCTS),
            "clean_sessions": (sessions, SESSIONS), "clean_events": (events, EVENTS),
            "clean_orders": (orders, ORDERS), "clean_experiment_assignments": (assignments, ASSIGN)}
    return LazyFrames({k: (lambda rows=rows, schema=schema: spark.createDataFrame(list(rows), schema))
                       for k, (rows, schema) in spec.items()})


def order(oid, sid, uid, when, revenue, variant="control"):
    return (oid, sid, uid, ts(when), revenue, revenue, 1, "mobile", "EUROPE", "new", True, "app", variant)


def event(eid, sid, uid, when, name, product=None):
    return (eid, sid, uid, ts(when), name, product, "mobile", "EUROPE", "new", True, "app")
