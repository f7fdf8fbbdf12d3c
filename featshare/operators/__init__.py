"""Relational operators over feature and metadata tables."""

from featshare.operators.changes import change_feed, change_feed_by_blocks, snapshot_as_of
from featshare.operators.links import broken_links, online_name_collisions, resolve_links
from featshare.operators.lookup import FeatureLookup, create_training_set, feature_lookup, feature_spec
from featshare.operators.quality import (error_triage, store_name_audit, validate_run_configs,
                                         validate_target_configs)
from featshare.operators.readiness import poll_samples, publish_rollup, readiness
from featshare.operators.registry import (dependency_drift, dependency_summary, discover_model,
                                          distinct_dependencies, effective_share,
                                          latest_model_version, schema_share, shared_by_many,
                                          version_for_run, versions_desc, wanted_objects)
from featshare.operators.sharing import (already_shared, catalog_plan, endpoint_plan,
                                         endpoint_status, grant_plan, list_recipients, list_shares,
                                         recipient_plan, share_details, share_update_plan, shareable)
from featshare.operators.training import score_batch, train_linear

__all__ = [n for n in dir() if not n.startswith("_")]
