"""What can go wrong while a schema is planned. Each has a stable code."""

from __future__ import annotations


class PlanError(Exception):
    code = "schema_error"

    def __init__(self, message: str, path: str | None = None) -> None:
        super().__init__(message)
        self.path = path

    def as_dict(self) -> dict:
        return {"code": self.code, "message": str(self), "path": self.path}


class SchemaError(PlanError):
    pass


class DepthExceeded(PlanError):
    code = "recursion_depth_exceeded"


class UnresolvableRef(PlanError):
    code = "unresolvable_ref"


class JsonParseError(PlanError):
    code = "json_parse_error"


class RehydrationError(PlanError):
    code = "rehydration_error"


class CodecVersionMismatch(PlanError):
    code = "codec_version_mismatch"


class UnsupportedFeature(PlanError):
    code = "unsupported_feature"


class ProviderCompatFailure(PlanError):
    code = "provider_compat_error"
