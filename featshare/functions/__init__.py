"""Column functions: everything here returns a Column or a map-only DataFrame."""

from featshare.functions.config import normalize_configs, secret_scan, truthy, missing_to_null
from featshare.functions.envelope import result_json
from featshare.functions.model import (FeatureFunction, LinearModel, check_signature,
                                       feature_function, infer_signature, predict, predict_col)
from featshare.functions.names import (dns_name, endpoint_name, invocation_url, online_name,
                                       shared_name, short_name, source_endpoint_name)
from featshare.functions.states import error_class, state_class

__all__ = [
    "normalize_configs", "secret_scan", "truthy", "missing_to_null", "result_json",
    "FeatureFunction", "LinearModel", "check_signature", "feature_function", "infer_signature",
    "predict", "predict_col", "dns_name", "endpoint_name", "invocation_url", "online_name",
    "shared_name", "short_name", "source_endpoint_name", "error_class", "state_class",
]
