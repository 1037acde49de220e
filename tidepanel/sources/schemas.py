"""Explicit schemas of the persisted tables."""
from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(*_field(p)) for p in spec.split()])


def _field(part: str):
    name, kind = part.split(":")
    return name, {"s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampType(), "i": T.IntegerType(),
                  "l": T.LongType(), "b": T.BooleanType()}[kind]


BARS = _schema("symbol:s date:t open:d high:d low:d close:d volume:d adj_close:d")
MARKET_DATA = _schema("symbol:s date:t open:d high:d low:d close:d volume:d adjusted_close:d returns:d log_returns:d")
FUNDAMENTAL_EAV = _schema("symbol:s date:t metric_name:s metric_value:d period_type:s sector:s industry:s data_source:s")
MACRO = _schema("date:t indicator_name:s indicator_value:d frequency:s category:s data_source:s")
FEATURES = _schema("symbol:s date:t feature_name:s feature_value:d feature_category:s normalization_method:s")
REGIMES = _schema("date:t regime_id:i regime_probability:d regime_name:s model_version:s confidence_score:d")
PREDICTIONS = _schema("model_id:i symbol:s prediction_date:t target_date:t prediction_value:d "
                      "prediction_uncertainty:d regime_context:s confidence_score:d actual_value:d")
ORDERS = _schema("order_id:s symbol:s side:s quantity:d order_type:s price:d created_time:t status:s "
                 "filled_quantity:d avg_fill_price:d")
FILLS = _schema("order_id:s symbol:s side:s quantity:d price:d timestamp:t commission:d")
QUOTES = _schema("symbol:s timestamp:t price:d volume:d high:d low:d open:d")
