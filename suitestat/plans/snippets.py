"""Short pieces of test code as call sites, with what a reader finds in each: the orders of the driver's tables hold one each.

@ stands for a number of the order.  A call: start, stop, method, receiver type, receiver
expression, arguments, types of arguments, constructor.  What is found: framework,
family, request role, response role, mocking, verb, path, names (headers | queries |
path variables | form fields), body.  ASKED: what the events ask for in the end.
GAVE: what builders gave (event, builder, properties).
"""

from __future__ import annotations

MVC = "org.springframework.test.web.servlet."
RA = "io.restassured."
U = "UNKNOWN"


def call(start, stop, method, receiver="", expr="", args=(), types=(), ctor=False):
    return start, stop, method, receiver, expr, list(args), list(types), ctor


def found(framework, family, asks=None, answers=None, verb=U, path="", names="|||", body=False, mocking=None):
    return framework, family, asks, answers, mocking, verb, path, names, body


NOTHING = (None,) * 9

#: (calls with what is found, asked, gave) of each piece.
SNIPPETS: tuple[tuple[list, list, list], ...] = (
    # mockMvc.perform(post("/orders/@").header("X-A", "1").queryParam("q", "v").content("{}")).andExpect(status().isOk())
    (
        [
            (call(0, 80, "perform", MVC + "MockMvc", "mockMvc", ["post(...)"]), found("mockmvc", "mockmvc.request_executor", "event")),
            (call(0, 110, "andExpect", MVC + "ResultActions", "", ["status().isOk()"]), found("mockmvc", "mockmvc.response_inspector", None, "inspector")),
            (call(16, 30, "post", MVC + "request.MockMvcRequestBuilders", "", ['"/orders/@"'], ["java.lang.String"]), found("mockmvc", "mockmvc.request_factory", "builder", None, "POST", "/orders/@")),
            (call(16, 45, "header", MVC + "request.MockHttpServletRequestBuilder", "", ['"X-A"', '"1"']), found("mockmvc", "mockmvc.request_builder", "builder", names="x-a|||")),
            (call(16, 60, "queryParam", MVC + "request.MockHttpServletRequestBuilder", "", ['"q"', '"v"']), found("mockmvc", "mockmvc.request_builder", "builder", names="|q||")),
            (call(16, 75, "content", MVC + "request.MockHttpServletRequestBuilder", "", ['"{}"']), found("mockmvc", "mockmvc.request_builder", "builder", body=True)),
            (call(92, 99, "status", MVC + "result.MockMvcResultMatchers", ""), found("mockmvc", "mockmvc.matcher_root", None, "matcher")),
            (call(92, 106, "isOk", MVC + "result.StatusResultMatchers", ""), found("mockmvc", "mockmvc.status_assertion", None, "status-assertion")),
        ],
        [(0, "POST", "/orders/@", "x-a|q||", True)],
        [(0, 2, "http_method,path"), (0, 3, "header_names"), (0, 4, "query_names"), (0, 5, "has_body")],
    ),
    # given().baseUri("http://localhost:8080").basePath("api").param("p", 1).when().post("/items/{id}", @)
    (
        [
            (call(0, 7, "given", RA + "RestAssured", ""), found("rest-assured", "rest-assured.request_factory", "builder")),
            (call(0, 40, "baseUri", RA + "specification.RequestSpecification", "", ['"http://localhost:8080"']), found("rest-assured", "rest-assured.request_builder", "builder")),
            (call(0, 55, "basePath", RA + "specification.RequestSpecification", "", ['"api"']), found("rest-assured", "rest-assured.request_builder", "builder", path="/api")),
            (call(0, 70, "param", RA + "specification.RequestSpecification", "", ['"p"', "1"]), found("rest-assured", "rest-assured.request_builder", "builder")),
            (call(0, 77, "when", RA + "specification.RequestSpecification", ""), found("rest-assured", "rest-assured.request_builder", "builder")),
            (call(0, 99, "post", RA + "specification.RequestSender", "", ['"/items/{id}"', "@"]), found("rest-assured", "rest-assured.request_event", "event", None, "POST", "/items/{id}", "||id|")),
            (call(0, 106, "then", RA + "response.Response", ""), found("rest-assured", "rest-assured.response_inspector", None, "inspector")),
            (call(0, 122, "statusCode", RA + "response.ValidatableResponse", "", ["201"]), found("rest-assured", "rest-assured.status_assertion", None, "status-assertion")),
        ],
        [(5, "POST", "/api/items/{id}", "||id|p", False)],
        [(5, 2, "path"), (5, 3, "form_names")],
    ),
    # Request request = new Request.Builder().url("http://localhost/files/" + @).header("Authorization", token).build(); client.newCall(request).execute()
    (
        [
            (call(0, 20, "Builder", "okhttp3.Request$Builder", "", ctor=True), NOTHING),
            (call(0, 60, "url", "okhttp3.Request$Builder", "", ['"http://localhost/files/" + @']), found("okhttp", "okhttp.request", "builder", path="http://localhost/files/")),
            (call(0, 90, "header", "okhttp3.Request.Builder", "", ['"Authorization"', "token"]), found("okhttp", "okhttp.request", "builder", names="authorization|||")),
            (call(0, 98, "build", "okhttp3.Request$Builder", ""), NOTHING),
            (call(200, 225, "newCall", "okhttp3.OkHttpClient", "client", ["request"]), found("okhttp", "okhttp.request", "builder")),
            (call(200, 235, "execute", "okhttp3.Call", ""), found("okhttp", "okhttp.request", "event")),
        ],
        [(5, "GET", "http://localhost/files/", "authorization|||", False)],
        [(5, 1, "path"), (5, 2, "headers,header_names,auth_hints")],
    ),
    # RequestEntity e = RequestEntity.put("/a/@").header(HttpHeaders.ACCEPT, "x").body(dto); template.exchange(e, X.class); template.getForObject("/b?x=1&y", X.class)
    (
        [
            (call(0, 30, "put", "org.springframework.http.RequestEntity", "RequestEntity", ['"/a/@"']), found("rest-template", "rest-template.request", "builder", None, "PUT", "/a/@")),
            (call(0, 60, "header", "org.springframework.http.RequestEntity$BodyBuilder", "", ["HttpHeaders.ACCEPT", '"x"']), found("rest-template", "rest-template.request", "builder", names="accept|||")),
            (call(0, 70, "body", "org.springframework.http.RequestEntity$BodyBuilder", "", ["dto"]), found("rest-template", "rest-template.request", "builder", body=True)),
            (call(100, 140, "exchange", "org.springframework.boot.test.web.client.TestRestTemplate", "template", ["e", "X.class"]), found("test-rest-template", "test-rest-template.request", "event")),
            (call(200, 240, "getForObject", "org.springframework.web.client.RestTemplate", "other", ['"/b?x=1&y"', "X.class"]), found("rest-template", "rest-template.request", "event", None, "GET", "/b?x=1&y", "|x,y||")),
        ],
        [(3, "PUT", "/a/@", "accept|||", True), (4, "GET", "/b?x=1&y", "|x,y||", False)],
        [(3, 0, "http_method,path"), (3, 1, "headers,header_names"), (3, 2, "has_body")],
    ),
    # client.target("http://localhost").path("users").path("@").request().get()
    (
        [
            (call(0, 35, "target", "jakarta.ws.rs.client.Client", "client", ['"http://localhost"']), found("jax-rs", "jaxrs-client.request", "builder")),
            (call(0, 50, "path", "jakarta.ws.rs.client.WebTarget", "", ['"users"']), found("jax-rs", "jaxrs-client.request", "builder", path="/users")),
            (call(0, 60, "path", "jakarta.ws.rs.client.WebTarget", "", ['"n@"']), found("jax-rs", "jaxrs-client.request", "builder", path="/n@")),
            (call(0, 70, "request", "jakarta.ws.rs.client.WebTarget", ""), found("jax-rs", "jaxrs-client.request", "builder")),
            (call(0, 76, "get", "jakarta.ws.rs.client.Invocation.Builder", ""), found("jax-rs", "jaxrs-client.request", "event", None, "GET")),
        ],
        [(4, "GET", "/users/n@", "|||", False)],
        [(4, 1, "path"), (4, 2, "path")],
    ),
    # webTestClient.get().uri("/x/@").<unknown>.header("A", "b").<unknown>.exchange(): receivers are lost after uri
    (
        [
            (call(0, 19, "get", "org.springframework.test.web.reactive.server.WebTestClient", "webTestClient"), found("webtestclient", "webtestclient.request_builder", "builder", None, "GET")),
            (call(0, 31, "uri", "org.springframework.test.web.reactive.server.WebTestClient$RequestHeadersUriSpec", "", ['"/x/@"']), found("webtestclient", "webtestclient.request_builder", "builder", path="/x/@")),
            (call(0, 48, "header", "", "", ['"A"', '"b"']), found("webtestclient", "webtestclient.request_builder", "builder", names="a|||")),
            (call(0, 60, "exchange", "", ""), found("webtestclient", "webtestclient.request_executor", "event")),
            (call(0, 80, "expectBody", "org.springframework.test.web.reactive.server.WebTestClient$ResponseSpec", "", ["X.class"]), found("webtestclient", "webtestclient.matcher_root", None, "body-assertion")),
        ],
        [(3, "GET", "/x/@", "a|||", False)],
        [(3, 0, "http_method"), (3, 1, "path"), (3, 2, "header_names")],
    ),
    # when(restTemplate.getForObject("/mocked/@", X.class)).thenReturn(x)
    (
        [
            (call(0, 60, "when", "org.mockito.Mockito", "Mockito", ["restTemplate.getForObject(...)"]), NOTHING),
            (call(5, 55, "getForObject", "org.springframework.web.client.RestTemplate", "restTemplate", ['"/mocked/@"', "X.class"]), found("rest-template", "rest-template.request", None, None, "GET", "/mocked/@", mocking="stubbing")),
            (call(0, 80, "thenReturn", "org.mockito.stubbing.OngoingStubbing", "", ["x"]), NOTHING),
        ],
        [],
        [],
    ),
    # HttpPost post = new HttpPost("/apache/@"); post.setEntity(e); client.execute(post): a constructor names the verb
    (
        [
            (call(0, 30, "HttpPost", "org.apache.http.client.methods.HttpPost", "", ['"/apache/@"'], ctor=True), found("apache-httpclient", "apache-httpclient.request", "builder", None, "POST", "/apache/@")),
            (call(100, 120, "setEntity", "org.apache.http.client.methods.HttpPost", "post", ["e"]), found("apache-httpclient", "apache-httpclient.request", "builder", body=True)),
            (call(200, 230, "execute", "org.apache.http.impl.client.CloseableHttpClient", "client", ["post"], ["org.apache.http.client.methods.HttpPost"]), found("apache-httpclient", "apache-httpclient.request", "event", None, "POST")),
        ],
        [(2, "POST", "/apache/@", "|||", True)],
        [(2, 0, "path"), (2, 1, "has_body")],
    ),
    # headers.setBearerAuth(t); headers.add("X-Id", i); webClient.post().uri("/w/@").headers(headers).retrieve()
    (
        [
            (call(0, 25, "setBearerAuth", "org.springframework.http.HttpHeaders", "headers", ["t"]), NOTHING),
            (call(100, 125, "add", "org.springframework.http.HttpHeaders", "headers", ['"X-Id"', "i"]), NOTHING),
            (call(200, 216, "post", "org.springframework.web.reactive.function.client.WebClient", "webClient"), found("webclient", "webclient.request", "builder", None, "POST")),
            (call(200, 230, "uri", "org.springframework.web.reactive.function.client.WebClient$RequestBodyUriSpec", "", ['"/w/@"']), found("webclient", "webclient.request", "builder", path="/w/@")),
            (call(200, 248, "headers", "org.springframework.web.reactive.function.client.WebClient.RequestBodySpec", "", ["headers"]), found("webclient", "webclient.request", "builder", names="authorization,x-id|||")),
            (call(200, 259, "retrieve", "org.springframework.web.reactive.function.client.WebClient$RequestHeadersSpec", ""), found("webclient", "webclient.request", "event")),
        ],
        [(5, "POST", "/w/@", "authorization,x-id|||", False)],
        [(5, 2, "http_method"), (5, 3, "path"), (5, 4, "headers,header_names")],
    ),
    # http.blocking.exchange("/m/@"), karate path("a", "b", id).method("PATCH", body), list.get(0)
    (
        [
            (call(0, 40, "exchange", "io.micronaut.http.client.BlockingHttpClient", "client", ['"/m/@"'], ["java.lang.String"]), found("micronaut-client", "micronaut-client.request", "event", None, "GET", "/m/@")),
            (call(100, 120, "url", "com.intuit.karate.Http", "Http", ['"http://localhost:8080/"']), found("karate", "karate.request", "builder")),
            (call(100, 150, "path", "com.intuit.karate.Http", "", ['"a"', '"b@"', "id"]), found("karate", "karate.request", "builder", path="/a/b@")),
            (call(100, 180, "method", "com.intuit.karate.Http", "", ['"PATCH"', "body"]), found("karate", "karate.request", "event", None, "PATCH", body=True)),
            (call(200, 210, "get", "java.util.List", "list", ["0"]), NOTHING),
        ],
        [(0, "GET", "/m/@", "|||", False), (3, "PATCH", "/a/b@", "|||", True)],
        [(3, 2, "path")],
    ),
)
