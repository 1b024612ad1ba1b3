"""Run options.  Every threshold an operator uses is a field here.

Limits are off (None) unless a caller asks for the top of something.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Date the "is it maintained" test counts back from.  A parameter, never
    # the wall clock, so a re-run of one snapshot gives one answer.
    as_of: str = "2003-08-01 00:00:00"
    min_stars: int = 50
    # A host lists contributors in pages of 100; None means rosters are whole.
    contributor_pages: int | None = None
    canonical_stars: int = 1000
    canonical_forks: int = 100
    role_discovery_floor: int = 1000
    widely_used_forks: int = 25
    min_ranked_commits: int = 10
    min_merged_prs: int = 5
    min_index_commits: int = 15
    path_commit_cap: int | None = None
    last_releases: int | None = None
    org_repo_limit: int | None = None
    packages_per_registry: int | None = None
    proposals_per_series: int | None = None
    include_private: bool = False
    max_accounts: int | None = None
    max_hub_accounts: int | None = None
    name_search_limit: int | None = None
    refresh_days: int = 30
    refresh_budget: int | None = None
    org_refresh_limit: int | None = None
    result_version: int = 6
