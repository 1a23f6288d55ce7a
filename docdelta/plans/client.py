"""Summaries by a chat-completions service, for those who ask for one; without it nothing is ever sent."""

from __future__ import annotations

import json
import time
import urllib.request
from dataclasses import dataclass

OFF = ("", "none", "disabled")
PUBLIC_URL = "https://api.openai.com/v1/chat/completions"
TASK = (
    "You are given one edit between two versions of a manual, as JSON. "
    "Answer with a single plain sentence for the table of revisions that says what was edited and where. Use only facts of the JSON."
)
FIELDS = ("change_type", "section_number", "section_title", "old_snippet", "new_snippet")


@dataclass(frozen=True)
class ChatClient:
    """Maps a change (a dict) to a sentence, or to "" whenever the service gives none.

    It is off without a provider or a key, and for any provider but ``openai``
    without an address. Each change costs at most ``attempts`` requests of
    ``timeout_seconds``; as it runs on executors, their cores bound how many
    are under way at once.
    """

    base_url: str
    api_key: str
    model: str
    timeout_seconds: int = 30
    provider: str = "custom"
    attempts: int = 2

    @property
    def address(self) -> str:
        if self.provider.lower() in OFF or not self.api_key:
            return ""
        return self.base_url or (PUBLIC_URL if self.provider.lower() == "openai" else "")

    def request(self, change: dict) -> urllib.request.Request:
        edit = json.dumps({k: change.get(k, "") for k in FIELDS}, ensure_ascii=False)
        turns = [{"role": role, "content": text} for role, text in (("system", TASK), ("user", edit))]
        body = json.dumps({"model": self.model, "temperature": 0, "messages": turns}).encode()
        return urllib.request.Request(self.address, data=body, headers={"Content-Type": "application/json", "Authorization": "Bearer " + self.api_key})

    def __call__(self, change: dict) -> str:
        for attempt in range(self.attempts if self.address else 0):
            try:
                with urllib.request.urlopen(self.request(change), timeout=self.timeout_seconds) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"].strip()
            except (LookupError, TypeError, AttributeError, json.JSONDecodeError):
                return ""  # an answer, but not one to use
            except (OSError, ValueError):
                time.sleep(0.2 * attempt)
        return ""


def duration(seconds: float | None) -> str:
    """Seconds for readers: tenths below a minute, else minutes and whole seconds."""
    left = seconds if seconds and seconds > 0 else 0.0
    if left < 60:
        return "%.1f sec" % left
    return "%02d:%02.0f min" % divmod(left, 60)
