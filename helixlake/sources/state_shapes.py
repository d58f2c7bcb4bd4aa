"""The fields of stored workbench states, their kinds, defaults and known values."""

from helixlake.functions.shapes import Choice, Flag, List, Map, Number, Record, Text, Whole
from helixlake.sources import constants as k

PAYLOAD_TOOLS = ("pathd", "fbasim", "cethx", "catdes", "dyncon", "cellfree", "dbtlflow", "proevol", "gecair", "genmim", "multio", "scspatial", "nexai")
VALIDITIES = ("real", "partial", "demo")
RUN_STATUS = ("ok", "simulated", "blocked", "gated", "demoOnly")
SOURCES = ("analysis", "tool", "system", "literature")
SURFACES = tuple(s[0] for s in k.SURFACES)
PRODUCT = "Target Product"


def texts() -> List:
    return List(Text())


#: Times that a state lacks are 0 here, so that one input always has one result.
PROJECT = Record({
    "id": Text(""), "title": Text("Synthetic Biology Program"), "summary": Text(""), "targetProduct": Text(PRODUCT), "sourceQuery": Text(), "status": Choice(("active", "iterating", "draft"), "draft"),
    "isDemo": Flag(), "createdAt": Number(0), "updatedAt": Number(0),
})
EVIDENCE = Record({
    "id": Text(), "sourceKind": Choice(SOURCES, "literature"), "title": Text(""), "abstract": Text(""), "authors": texts(), "journal": Text(), "year": Text(), "doi": Text(), "url": Text(), "source": Text(), "query": Text(), "savedAt": Number(0),
}, needs=("id",))
TOOL_RUN = Record({"id": Text(), "toolId": Text(), "stageId": Text(), "title": Text(""), "summary": Text(""), "isSimulated": Flag(), "createdAt": Number(0)}, needs=("id", "toolId"))
CHECKPOINT = Record({"id": Text(), "status": Choice(("active", "complete", "pending"), "pending"), "summary": Text(""), "updatedAt": Number(0)}, needs=("id",))
RECOMMENDATION = Record({"id": Text(), "toolId": Text(), "source": Choice(("analysis", "tool", "flow"), "flow"), "reason": Text("")}, needs=("id", "toolId"))
GATE = Record({
    "status": Choice(("ok", "blocked", "gated", "demoOnly")), "blockCode": Text(), "reason": Text(), "allowedSurfaces": List(Choice(SURFACES)), "blockedSurfaces": List(Choice(SURFACES)), "overridePath": Choice(("human-review", "not-allowed")),
}, needs=("status", "reason", "allowedSurfaces", "blockedSurfaces"))
PAYLOAD = Whole({"validity": Choice(VALIDITIES), "toolId": Text(), "updatedAt": Number()})
MISSING = {"minRequired": Number(0, 0), "have": Number(0, 0), "kinds": texts()}
SNAPSHOT = Record({
    "count": Number(0, 0), "selectedCount": Number(0, 0), "evidenceItemIds": texts(), "selectedEvidenceIds": texts(), "status": Choice(("satisfied", "missing", "not-required"), "not-required"), "missingEvidence": Record(MISSING | {"missingKinds": texts()}, always=True),
})
EXECUTION = Record({"projectRef": Text(), "analyzeRef": Text(), "upstreamToolIds": texts(), "upstreamArtifactIds": texts(), "dependencySignature": Text("")}, always=True)
RUN = Record({
    "id": Text(), "toolId": Text(), "payloadSnapshot": Whole(), "stageId": Text(), "targetProduct": Text(PRODUCT), "sourceArtifactId": Text(), "upstreamArtifactIds": texts(), "execution": EXECUTION, "summary": Text(""), "createdAt": Number(0),
    "isSimulated": Flag(), "status": Choice(RUN_STATUS), "statusReason": Text(), "blockingUpstreamToolIds": texts(), "confidence": Number(), "uncertainty": Number(), "validity": Choice(VALIDITIES), "humanGateRequired": Flag(), "iteration": Number(None, 0), "evidenceSnapshot": SNAPSHOT,
}, needs=("id", "toolId", "payloadSnapshot"))
CONTROL = Record({
    "machineState": Choice(("idle", "targetSet", "pathdReady", "fbasimReady", "catdesReady", "dynconReady", "cellfreeReady", "dbtlCommitted"), "idle"), "status": Choice(("idle", "ready", "blocked", "gated", "demoOnly", "complete"), "idle"),
    "currentToolId": Text(), "nextRecommendedNode": Text(), "missingEvidence": Record(MISSING, always=True), "confidence": Number(), "uncertainty": Number(), "validity": Choice(VALIDITIES), "humanGateRequired": Flag(), "nextNodeIsContractOnly": Flag(),
    "isDemoOnly": Flag(), "latestRunStatus": Choice(RUN_STATUS), "latestRunToolId": Text(), "reasonCodes": texts(), "explanation": Text(""), "iteration": Number(0, 0), "updatedAt": Number(0),
}, always=True, absent={"nextRecommendedNode": "pathd", "reasonCodes": ["NO_TARGET"]})
NODE, EDGE = Whole({"id": Text(filled=True)}), Whole({"start": Text(filled=True), "end": Text(filled=True)})
ANALYSIS = Record({
    "id": Text(), "title": Text(""), "summary": Text(""), "targetProduct": Text(PRODUCT), "nodes": List(NODE), "edges": List(EDGE), "pathwayCandidates": List(Record({"id": Text(), "label": Text(""), "description": Text(""), "nodeCount": Number(0), "edgeCount": Number(0)}, needs=("id",))),
    "bottleneckAssumptions": List(Record({"id": Text(), "label": Text(""), "detail": Text(""), "yieldLossPercent": Number()}, needs=("id",))), "enzymeCandidates": List(Record({"id": Text(), "label": Text(""), "rationale": Text("")}, needs=("id",))),
    "thermodynamicConcerns": texts(), "recommendedNextTools": texts(), "evidenceTraceIds": texts(), "sourceProvider": Text(), "generatedAt": Number(0),
}, needs=("id",))
NODE_ROLES = ("metabolite", "enzyme", "gene", "cofactor", "intermediate", "impurity", "hypothesis")
EDGE_ROLES = ("evidence-backed-transition", "inferred-transition", "catalysis", "regulation", "abstraction")
PACKET = Record({name: shape for name, shape in EVIDENCE.fields.items() if name != "savedAt"}, needs=("id",))
ROUTE = Record({"id": Text(), "label": Text(""), "nodeIds": texts(), "edgeKeys": texts(), "rank": Number(1, 1)}, needs=("id",))
ARTIFACT = Record({
    "id": Text(), "schemaVersion": Number(1, 1), "version": Number(0, 0), "status": Choice(("compiled", "error", "draft"), "draft"), "sourcePage": Choice(("research", "pathd", "analyze"), "analyze"),
    "intake": Record({"sourceQuery": Text(), "targetMolecule": Text(), "projectIntent": Text(), "rawAnalyzeInput": Text("")}, always=True), "evidencePackets": List(PACKET),
    "atomicPathwayGraph": Record({"nodes": List(Whole({"id": Text(), "role": Choice(NODE_ROLES)})), "edges": List(Whole({"start": Text(), "end": Text(), "key": Text(filled=True), "role": Choice(EDGE_ROLES)}))}),
    "candidateRoutes": List(ROUTE), "provenance": Record({"compiledFrom": Choice(("literature-bundle", "pdf", "image", "url", "manual-text"), "manual-text"), "evidencePacketIds": texts(), "sourceProvider": Text()}, always=True),
    "workbench": Record({"scientificStage": Choice(("simulate-optimize", "engineer-host", "test-learn", "design"), "design")}, always=True), "thermodynamics": Record({"concerns": texts()}), "flux": Record({"notes": texts()}), "createdAt": Number(0), "updatedAt": Number(0),
}, needs=("id",))
STATE = Record({
    "schemaVersion": Number(1), "revision": Number(0, 0), "lastMutationAt": Number(0, 0), "activeArtifactId": Text(), "project": PROJECT, "evidenceItems": List(EVIDENCE), "selectedEvidenceIds": texts(), "draftAnalyzeInput": Text(""),
    "workflowArtifact": ARTIFACT, "analyzeArtifact": ANALYSIS, "toolRuns": List(TOOL_RUN), "toolPayloads": Map(PAYLOAD, PAYLOAD_TOOLS), "payloadAdmissionDecisionsByToolId": Map(GATE), "runArtifacts": List(RUN),
    "checkpoints": List(CHECKPOINT), "nextRecommendations": List(RECOMMENDATION), "workflowControl": CONTROL,
})
