"""Sources and sinks: feature tables, fixture tables, requests, share mounts, published copies."""

from featshare.sources.feature_tables import (check_not_null, check_primary_key,
                                              create_feature_table, drop_feature_table,
                                              ensure_feature_table, ensure_registered_table, read_feature_table,
                                              register_feature_table)
from featshare.sources.fixtures import Fixtures
from featshare.sources.publish import (apply_changes, publish_changes, publish_many,
                                       publish_snapshot, read_published, read_published_for)
from featshare.sources.requests import infer_request_signature, parse_score_requests, read_score_requests, request_rejects
from featshare.sources.shares import mount_share, read_share

__all__ = [
    "check_not_null", "check_primary_key", "create_feature_table", "drop_feature_table",
    "ensure_feature_table", "ensure_registered_table", "read_feature_table", "register_feature_table", "Fixtures",
    "apply_changes", "publish_changes", "publish_many", "publish_snapshot", "read_published", "read_published_for",
    "parse_score_requests", "read_score_requests", "request_rejects", "infer_request_signature", "mount_share", "read_share",
]
