"""Report parameters.

The reference hard-codes dates, merchant words, service codes and benefit
amounts into SQL text; here they are parameters with defaults chosen for the
TPC-H-shaped test tables.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace


def _d(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


@dataclass(frozen=True)
class Params:
    # billing questions: closed day range, merchant word, optional account
    start: str = "1997-07-01"
    end: str = "1997-09-30"
    merchant: str = "plate"
    account: int | str | None = None  # text where leading zeros matter
    # "today" of the reference (SQLite 'now'), always explicit here
    as_of: str = "1997-09-15"
    # the service whose monthly limit is asked about
    service: str = "PROMO"
    # services that grant a discount (the reference's service table)
    known_services: tuple[str, ...] = ("PROMO", "STANDARD", "ECONOMY")
    # month asked by prefix, yyyyMM
    limit_month: str = "199708"
    # promotions overlapping a range (F8)
    promo_start: str = "1997-07-01"
    promo_end: str = "1997-09-30"
    promo_word: str = "plate"
    # messages containing a word
    message_word: str = "the"
    # campaign question: applications, campaign messages and sales
    campaign_word: str = "the"
    campaign_benefit_word: str = "an"
    campaign_start: str = "1996-01-01"
    campaign_end: str = "1996-12-31"
    campaign_min_amount: float = 10000.0
    campaign_inclusive: bool = True
    campaign_product: str = "O"
    campaign_channel: str | None = None
    benefit: int = 10000
    # top-k report
    top_k: int = 5
    # chunk widths for JSON lists (keys per chunk); bounds every collected group
    payment_chunk_lines: int = 2048
    promo_chunk_parts: int = 512
    message_chunk_docs: int = 32
    # prompts and attempts
    context_window: int = 16384
    vocabulary: str = "byte_bpe_50k.json"  # of the token counts
    retry_budget: int = 6
    display_chars: int = 300
    # span episodes: time bucket used to split a user's timeline (skew guard)
    episode_bucket: str = "hour"
    extra: dict = field(default_factory=dict)

    @property
    def start_date(self) -> _dt.date:
        return _d(self.start)

    @property
    def end_exclusive(self) -> str:
        return (_d(self.end) + _dt.timedelta(days=1)).isoformat()

    @property
    def month_start(self) -> str:
        return _d(self.as_of).replace(day=1).isoformat()

    @property
    def month_end_exclusive(self) -> str:
        d = _d(self.as_of).replace(day=1)
        nxt = d.replace(year=d.year + 1, month=1) if d.month == 12 else d.replace(month=d.month + 1)
        return nxt.isoformat()

    @property
    def limit_month_start(self) -> str:
        return f"{self.limit_month[:4]}-{self.limit_month[4:6]}-01"

    @property
    def limit_month_end_exclusive(self) -> str:
        d = _d(self.limit_month_start)
        nxt = d.replace(year=d.year + 1, month=1) if d.month == 12 else d.replace(month=d.month + 1)
        return nxt.isoformat()

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
