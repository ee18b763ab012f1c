"""Rule configuration."""

import json
from dataclasses import dataclass, fields

from tidewatch.functions.links import blocklist_entries
from tidewatch.functions.text import java_pattern, literal_pattern, severity_name
from tidewatch.functions.times import MILLI, SECOND


@dataclass(frozen=True)
class SpamRule:
    """Keywords match literally in any case, regexes as written; keywords come first."""
    keywords: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    severity: str = "low"

    def patterns(self) -> list[tuple[str | None, str]]:
        """Each pattern with the keyword it stands for, if it is one. Empty ones are skipped."""
        return ([(k, literal_pattern(k)) for k in self.keywords if k]
                + [(None, java_pattern(r)) for r in self.regexes if r])


@dataclass(frozen=True)
class LinkRule:
    domains: tuple[str, ...] = ()
    severity: str = "low"

    def entries(self) -> list[str]:
        return blocklist_entries(list(self.domains))


@dataclass(frozen=True)
class RateRule:
    """At least `threshold` events of one author within `window` microseconds."""
    window: int = SECOND
    threshold: int = 1
    severity: str = "low"

    def __post_init__(self):
        if self.window <= 0:
            object.__setattr__(self, "window", SECOND)
        if self.threshold < 1:
            object.__setattr__(self, "threshold", 1)


@dataclass(frozen=True)
class RuleSet:
    """The configured rules. A rule without input is off."""
    # The defaults of the configuration file.
    spam_keywords: tuple[str, ...] = ("BUY NOW", "free crypto", "free bitcoin", "[SPAM]")
    spam_regexes: tuple[str, ...] = (r"(?i)earn\s+money\s+fast",)
    spam_severity: str = "medium"
    blocklist_domains: tuple[str, ...] = ("spam-link.xyz", "phishing.example.com")
    blocklist_severity: str = "high"
    rate_window_ms: int = 1000
    rate_threshold: int = 50
    rate_severity: str = "medium"

    @classmethod
    def from_json(cls, path: str) -> "RuleSet":
        """Read the known fields of a JSON object; other fields are ignored."""
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v
                      for k, v in given.items() if k in known})

    def spam(self) -> SpamRule | None:
        if self.spam_keywords or self.spam_regexes:
            return SpamRule(tuple(self.spam_keywords), tuple(self.spam_regexes),
                            severity_name(self.spam_severity))
        return None

    def links(self) -> LinkRule | None:
        if self.blocklist_domains:
            return LinkRule(tuple(self.blocklist_domains), severity_name(self.blocklist_severity))
        return None

    def rate(self) -> RateRule | None:
        if self.rate_threshold > 0 and self.rate_window_ms > 0:
            return RateRule(self.rate_window_ms * MILLI, self.rate_threshold,
                            severity_name(self.rate_severity))
        return None
